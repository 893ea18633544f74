"""Written intermediate tables in the folder that all executors share, and their end.

Whoever opens scratch() owns the tables written inside it and deletes them on leaving, but for those that it keeps. Tables written
outside belong to the application: the file system deletes them when the application ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..sources.folders import new_folder
from ..sources.folders import place as _place

_SCRATCH: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: cuts the lineage, survives the loss of an executor, is computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scorewright_path = path
    for made in _SCRATCH[-1:]:
        made.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    path = getattr(df, "_scorewright_path", None)
    if path:
        files, target = _place(df.sparkSession, path)
        files.delete(target, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are written inside, but for those passed to the function that it gives. What leaves the block must not read the others."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _SCRATCH.append(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _SCRATCH.pop()
        for df in made:
            if not any(df is k for k in kept):
                forget(df)
        for outer in _SCRATCH[-1:]:
            outer += kept


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows. A partition that is not written yet is read up to the bound."""
    return df.limit(rows + 1).count() <= rows


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
