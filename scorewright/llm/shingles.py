"""Word runs of texts, and near-duplicates by the Jaccard similarity of their sets.

A text is the set of its runs of `size` words (all its words as one run if it has no more); texts of equal sets are one node. Nodes that
share a bucket meet, and every link is verified on the sets themselves.

Before sets are read, pairs are compared by sketches: the parity of the hashes on each of 1024 bits. Sketches differ in no more bits than
the sets differ in runs, so what they rule out is surely below the similarity.

In each bucket all nodes are first compared with the smallest and the largest one. Buckets whose nodes are then in one component need nothing
more; in the others, nodes of different components are all compared, so every pair that meets is compared or linked already.
Texts that share much with a large group and are no near copies of it are thus compared, by sketch, with all nodes of their buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import written
from .components import components

#: Runs whose hashed values are held at once.
STEP = 4096
#: Long columns of a sketch.
SKETCH = [f"s{i}" for i in range(16)]


def run_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """Hashes of all runs, repeats included; words are split at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return np.array([hashed(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def multipliers(bands: int, rows: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(runs: np.ndarray, odd: np.ndarray, bands: int) -> list[int]:
    """A signed long for each band of the minima of odd * run (modulo 2^64)."""
    least = np.min([(odd[:, None] * runs[None, at : at + STEP]).min(axis=1) for at in range(0, len(runs), STEP)], axis=0)
    raw, width = least.tobytes(), least.nbytes // bands
    return np.array([xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b) for b in range(bands)], np.uint64).view(np.int64).tolist()


def sketch(runs: np.ndarray) -> np.ndarray:
    """The parity of the runs on each of the sketch's bits, as signed longs."""
    odd = np.bincount((runs >> np.uint64(20)).astype(np.int64) % (64 * len(SKETCH)), minlength=64 * len(SKETCH)) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _possible(a: str, b: str, least: float) -> Column:
    """Whether the sketches of the columns with these prefixes leave it open that the sets are as similar as `least`."""
    apart = reduce(Column.__add__, (F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in SKETCH))
    return F.greatest(apart, F.abs(F.col(a + "n") - F.col(b + "n"))) <= (1 - least) / (1 + least) * (F.col(a + "n") + F.col(b + "n")) + 1e-6


def _named(nodes: DataFrame, at: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(at + c) for c in ["node", "n", *SKETCH]))


def _sets(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("node"), pa.array([np.unique(run_hashes(t.as_py(), size, seed)).tobytes() for t in batch.column("text")], pa.binary())], ["node", "runs"])

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("u_runs"), batch.column("v_runs"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, least: float, seed: int) -> DataFrame:
    """The pairs (u, v) whose sets are as similar as `least`; only the texts of nodes in pairs are read again."""
    pairs = pairs.distinct().withColumnsRenamed({"u": "a_node", "v": "b_node"}).join(_named(nodes, "a_"), "a_node").join(_named(nodes, "b_"), "b_node")
    pairs = written(pairs.filter(_possible("a_", "b_", least)).select(F.col("a_node").alias("u"), F.col("b_node").alias("v")), "pairs")
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    asked = nodes.join(asked, "node", "left_semi").select("node", "row")
    sets = written(texts.join(asked, "row").select("node", "text").mapInArrow(_sets(size, seed), "node long, runs binary"), "sets")
    named = lambda at: sets.select(F.col("node").alias(at), F.col("runs").alias(f"{at}_runs"))
    return written(pairs.join(named("u"), "u").join(named("v"), "v").select("u", "v", "u_runs", "v_runs").mapInArrow(_alike(least), "u long, v long"), "alike")


def near_groups(texts: DataFrame, nodes: DataFrame, buckets: Column, size: int, least: float, seed: int) -> DataFrame:
    """(node, root) of all nodes that have a near-duplicate. texts (row, text); nodes (node, row of one of its texts, n, sketch); buckets: an array of longs."""
    bucket = Window.partitionBy("bucket")
    met = nodes.select(F.explode(buckets).alias("bucket"), "node").withColumns({"low": F.min("node").over(bucket), "high": F.max("node").over(bucket)})
    met = written(met.filter("low <> high"), "met")
    star = met.select(F.explode(F.array("low", "high")).alias("end"), "node").filter("end <> node").select(F.least("end", "node").alias("u"), F.greatest("end", "node").alias("v"))
    links = _verified(star, texts, nodes, size, least, seed)
    labels = written(components(links), "labels")
    rest = met.select("bucket", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).filter("low <> high and members > 2").select("bucket")
    rest = written(rest.join(mixed, "bucket", "left_semi"), "rest")
    a, b = (rest.select("bucket", F.col("node").alias(f"{k}_node"), F.col("root").alias(f"{k}_root")).join(_named(nodes, f"{k}_"), f"{k}_node") for k in "ab")
    cross = a.join(b, "bucket").filter("a_node < b_node and a_root <> b_root").filter(_possible("a_", "b_", least))
    more = _verified(cross.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")), texts, nodes, size, least, seed)
    if more.isEmpty():
        return labels
    return written(components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "labels")
