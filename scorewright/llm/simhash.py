"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius (65 of them at radius 2) and is shuffled on them. Two
fingerprints within the radius meet at some variant. All fingerprints that meet at one variant are distinct and lie in
one ball, so they are at most as many as the ball's variants whatever the corpus, and each is linked to the one before it:
copies are merged before they are emitted, and no list of all pairs is made. At an odd radius the ball's members
can be one bit too far apart, so pairs are then compared within the (bounded) ball. Every pair is verified.

one_of_each() groups texts whose sets of five-word runs are alike by 0.8 or more. Fingerprints of such texts mostly differ by 2 to 15 of 64
bits, which no ball of bearable size spans, so there the ball's variants are joined by the band hashes of the same runs as further
buckets, and the exact similarity of the sets verifies whatever meets. A pair of similarity s is missed by the bands with probability
(1 - s^rows)^bands: 7 in a million at 0.8 for the defaults, less above.

Defined results: null text has no words; no words give fingerprint zero, linked like any other; repeated rows are kept (by
one_of_each: one of them); very long texts are hashed whole; an empty table gives an empty result; other columns are ignored (by
one_of_each: kept, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shingles
from ._store import unused, written
from .components import HOT, components

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(votes: np.ndarray) -> int:
    """The bits that are set in over half the votes."""
    lanes = votes.view(np.uint8).reshape(-1, 8)
    out = 0
    for lane in range(8):
        counts = np.bincount(lanes[:, lane], minlength=256) @ _BITS
        for bit in np.flatnonzero(2 * counts > len(votes)).tolist():
            out |= 1 << (8 * lane + bit)
    return out


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Words are split at ASCII white space, A-Z lower-cased; the hash of each run of `size` words votes on 64 bits."""
    return majority(shingles.run_hashes(text, size, seed))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), _signed([fingerprint(t.as_py(), size, seed) for t in batch.column("text")])], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long of the same bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(size, seed), "doc_id long, fp long")


def masks(half: int) -> list[int]:
    """All differences of at most `half` bits, as signed longs."""
    found = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def variants(fp: Column, radius: int) -> Column:
    """All fingerprints within half the radius."""
    return F.transform(F.array(*map(F.lit, masks((radius + 1) // 2))), lambda m: fp.bitwiseXOR(m))


def near_links(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): verified links that join all fingerprints within the radius; those that share a ball form a chain."""
    ball = distinct_fps.select("fp", F.explode(variants(F.col("fp"), radius)).alias("variant"))
    if radius % 2:
        other = ball.select("variant", F.col("fp").alias("v"))
        met = ball.withColumnRenamed("fp", "u").join(other, "variant").filter("u < v").select("u", "v")
    else:
        beside = Window.partitionBy("variant").orderBy("fp")
        met = ball.select(F.col("fp").alias("u"), F.lag("fp").over(beside).alias("v")).filter("v is not null")
    return met.distinct().filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    fps = written(fingerprints(docs, size, seed), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members")), "classes")
    joined = written(components(near_links(classes.select("fp"), radius)), "labels")
    lowest = joined.join(classes, joined.node == classes.fp).groupBy("root").agg(F.min("first_id").alias("low"))
    labels = joined.join(lowest, "root").select(F.col("node").alias("fp"), "low")
    labels = written(classes.join(labels, "fp", "left").select("fp", "members", F.coalesce("low", "first_id").alias("component_id")), "components")
    # The rows of a hot fingerprint stay where they are: the few classes that hold so large a share of all rows are broadcast.
    hot = labels.filter(F.col("members") * HOT > (classes.agg(F.sum("members")).first()[0] or 0)).select("fp", F.col("component_id").alias("hot_id"))
    marked = fps.join(F.broadcast(hot), "fp", "left")
    rest = marked.filter("hot_id is null").drop("hot_id").join(labels, "fp")
    return marked.filter("hot_id is not null").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest.select("doc_id", "fp", "component_id"))


def _nodes(size: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = shingles.multipliers(bands, rows, seed)
        for batch in batches:
            node, fp, n, keys, sketches = [], [], [], [], []
            for text in batch.column("text"):
                every = shingles.run_hashes(text.as_py(), size, seed)
                runs = np.unique(every)
                node.append(xxhash.xxh64_intdigest(runs.tobytes(), seed))
                fp.append(majority(every))
                n.append(len(runs))
                sketches.append(shingles.sketch(runs))
                keys.append(shingles.band_keys(runs, odd, bands) if len(runs) else [])
            found = [_signed(node), _signed(fp), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, np.array(sketches, np.int64).reshape(-1, len(shingles.SKETCH)).T.copy())]
            yield pa.record_batch([batch.column("first"), *found], ["first", "node", "fp", "n", "keys", *shingles.SKETCH])

    return run


def one_of_each(docs: DataFrame, least: float = 0.8, size: int = 5, radius: int = 2, bands: int = 30, rows: int = 5, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id (a null one last), then of the smallest hash of its row.

    A doc_id names no row by itself, so rows are named by their number in a table that is written first.
    """
    at = unused(docs, "near_row")
    kept = written(docs.withColumn(at, F.monotonically_increasing_id()), "documents")
    whole = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t and "variant" not in t))
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), whole.alias("hash"), F.col(at).alias("row"))
    texts = kept.select(F.col(at).alias("row"), F.col("text").cast("string").alias("text"))
    found = kept.select(first.alias("first"), F.col("text").cast("string").alias("text"))
    schema = "first struct<last:boolean,doc_id:long,hash:long,row:long>, node long, fp long, n long, keys array<long>, " + ", ".join(f"{c} long" for c in shingles.SKETCH)
    found = written(found.mapInArrow(_nodes(size, bands, rows, seed), schema), "rows")
    nodes = found.groupBy("node").agg(F.min("first").alias("first"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "keys", *shingles.SKETCH)))
    nodes = written(nodes.withColumn("row", F.col("first.row")), "nodes")
    groups = shingles.near_groups(texts, nodes, F.concat("keys", variants(F.col("fp"), radius)), size, least, seed)
    rooted = nodes.select("node", "first").join(groups, "node", "left")
    best = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(at))
    return kept.join(best, at, "left_semi").select(docs.columns)
