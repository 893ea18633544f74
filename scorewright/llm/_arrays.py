"""Array expressions whose cost grows in proportion to the array: work is done on slices, so nothing that grows is copied for every element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 256
#: Code points of a piece of a text that spans are cut from.
PIECE = 1 << 15


def let(body: Callable[..., Column], *values: Column) -> Column:
    """body of the values, each evaluated once: inside a lambda, a Column from outside is run for every element."""
    bound = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(bound), lambda b: body(*(b[f"v{i}"] for i in range(len(values)))))[0]


def slices(xs: Column, size: int = SLICE) -> Column:
    """The array in slices; null or empty gives none."""
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda j: F.slice(xs, j * size + 1, size))
    return F.when(F.size(xs) > 0, let(cut, xs))


def _sums(xs: Column) -> Column:
    return F.aggregate(xs, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x))


def running(xs: Column) -> Column:
    """Sums of an array of longs up to and with each element; null for a null or empty array."""

    def joined(parts: Column, ends: Column) -> Column:
        shifted = F.zip_with(parts, ends, lambda p, end: let(lambda p, by: F.transform(p, lambda x: x + by), p, end - F.element_at(p, -1)))
        return F.flatten(shifted)

    with_ends = lambda parts: let(joined, parts, _sums(F.transform(parts, lambda p: F.element_at(p, -1))))
    return let(with_ends, F.transform(slices(xs), _sums))


def texts_at(text: Column, spans: Column) -> Column:
    """The parts of the text from start to end (code points) of each span. A span is cut from the pieces that it touches, not from the text's beginning."""

    def cut(pieces: Column, spans: Column) -> Column:
        def one(s: Column) -> Column:
            touched = F.sequence(F.floor(s.start / PIECE).cast("int"), F.floor((s.end - 1) / PIECE).cast("int"))
            part = lambda k: F.substring(F.get(pieces, k), (F.greatest(s.start - k * PIECE, F.lit(0)) + 1).cast("int"), (F.least(s.end - k * PIECE, F.lit(PIECE)) - F.greatest(s.start - k * PIECE, F.lit(0))).cast("int"))
            return F.when(s.end > s.start, F.array_join(F.transform(touched, part), "")).otherwise("")

        return F.transform(spans, one)

    pieces = lambda text: F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / PIECE).cast("int")), lambda k: F.substring(text, (k * PIECE + 1).cast("int"), F.lit(PIECE)))
    return let(cut, let(pieces, text), spans)
