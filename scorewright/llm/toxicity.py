"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of the lower-cased text, 3 to 6 long, by 64-bit hash. Their ratios of document
frequencies in toxic and other texts scale them, and a logistic regression with a penalty is fitted to the scaled
features. At most `sample_rows` labelled documents (those of the smallest hashes of their ids) and `features` n-grams are used
to fit, so fitting is of bounded size: exact counts of n-grams are summed and ranked by Spark, and only the chosen `features` and the
sample's lists of them reach the driver. Scoring reads every whole text once and moves nothing.

Defined results: null and empty texts get the score of no features; repeated rows are scored alike; an id labelled both toxic and not is passed
over; of rows that share a labelled id, the smallest text is fitted on; n-grams of equal rank go by hash; without labels of
both kinds every score is the share of toxic labels (0 if there is none); an empty table gives none; other columns are ignored (by
reject_toxic: kept).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import forget, written

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
PARTS = 24
#: A text is hashed in windows of so many characters (each n-gram in exactly one), which bounds memory for long texts.
WINDOW = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def hashes(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of all n-grams of the text between spaces, some at a time."""
    chars = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, len(chars), WINDOW):
        own = chars[at : at + WINDOW + SIZES[-1] - 1]
        rolled = own * _MIX
        for n in range(2, SIZES[-1] + 1):
            if len(own) < n:
                break
            rolled = (rolled[:-1] * _STEP) ^ (own[n - 1 :] * _MIX)
            if n in SIZES:
                mixed = (rolled ^ (rolled >> np.uint64(29))) * (_MIX + np.uint64(2 * n))
                yield (mixed ^ (mixed >> np.uint64(32)))[: WINDOW]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def present(text: str | None, wanted: np.ndarray) -> np.ndarray:
    """The distinct hashes of the text whose bucket is wanted (a flag for each bucket)."""
    found = [h[wanted[_bucket(h)]] for h in hashes(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


@dataclass(frozen=True)
class Model:
    grams: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        wanted = np.zeros(BUCKETS, bool)
        wanted[_bucket(self.grams)] = True
        return np.array([self._score(present(t, wanted)) for t in texts], float)

    def _score(self, found: np.ndarray) -> float:
        z = self.bias
        if len(self.grams) and len(found):
            at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
            z += self.weights[at[self.grams[at] == found]].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chi_square(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = a.astype(float), b.astype(float)
        n = na + nb
        out = n * (a * (nb - b) - b * (na - a)) ** 2.0 / (na * nb * (a + b) * (n - a - b) * 1.0)
    return np.nan_to_num(out, nan=0.0, posinf=0.0)


def log_ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    return np.log((a + 1) / (na + 2)) - np.log((b + 1) / (nb + 2))


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights of 0/1 features (already times their scale) and the bias; Newton steps solved by conjugate gradients on the whole sample."""
    n, k = len(rows), len(scale)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    value = scale[col]
    hold = np.append(np.full(k, penalty), 1e-6)

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=value * v[:k][col], minlength=n) + v[k]

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, weights=u[at] * value, minlength=k), u.sum())

    def loss(v: np.ndarray) -> float:
        z = times(v)
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (hold * v * v).sum())

    w = np.zeros(k + 1)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        grad, curve = back(p - y) + hold * w, p * (1 - p)
        spread = np.append(np.bincount(col, weights=curve[at] * value**2, minlength=k), curve.sum()) + hold
        move, rest = np.zeros(k + 1), -grad
        ahead = rest / spread
        size = first = float(rest @ ahead)
        for _ in range(100):
            if size <= 1e-8 * first:
                break
            bent = back(curve * times(ahead)) + hold * ahead
            step = size / float(ahead @ bent)
            move, rest = move + step * ahead, rest - step * bent
            new = float(rest @ (rest / spread))
            ahead, size = rest / spread + new / size * ahead, new
        part = 1.0
        while (then := loss(w + part * move)) > now and part > 1e-4:
            part /= 2
        if then > now - 1e-7 * abs(now):
            break
        w, now = w + part * move, then
    return w[:k] * scale, float(w[k])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            flags = np.zeros(BUCKETS, bool)
            for h in hashes(text.as_py()):
                flags[_bucket(h)] = True
            seen[label] += flags
            rows[label] += 1
    yield pa.record_batch([pa.array([rows.tobytes()], pa.binary()), pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], ["rows", "seen"])


def _grams(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(BUCKETS, bool)
        flags[wanted] = True
        for batch in batches:
            found = [present(t.as_py(), flags).view(np.int64) for t in batch.column("text")]
            edges = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            yield pa.record_batch([batch.column("toxic"), pa.ListArray.from_arrays(edges, pa.array(np.concatenate([*found, np.empty(0, np.int64)])))], ["toxic", "grams"])

    return run


def _numbers(grams: np.ndarray):
    """Each row's places in the sorted grams, at most as many as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(grams, np.array(x.as_py(), np.int64).view(np.uint64), assume_unique=True)).astype(np.uint16).tobytes() for x in batch.column("grams")]
            yield pa.record_batch([batch.column("toxic"), pa.array(found, pa.binary())], ["toxic", "numbers"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, features: int = 2048, penalty: float = 1.0) -> Model:
    """labels (doc_id, toxic 0/1): fit on documents that they name; labels that are null or neither 0 nor 1 are passed over. features: 65536 at most."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    named = named.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most sample_rows pairs of numbers are broadcast. The sample is kept in order, so that fitting is repeatable.
    sample = rows.join(F.broadcast(named), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = written(sample.repartition(PARTS), "labelled")
    seen, n = np.zeros((2, BUCKETS)), np.zeros(2, np.int64)
    for r in sample.coalesce(PARTS).mapInArrow(_counts, "rows binary, seen binary").collect():
        seen += np.frombuffer(zlib.decompress(r.seen), np.int32).reshape(2, BUCKETS)
        n += np.frombuffer(r.rows, np.int64)
    if not n.all():
        forget(sample)
        share = n[1] / max(1, n.sum())
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    wanted = np.argsort(-chi_square(seen[1], seen[0], *n[::-1]), kind="stable")[:features]
    held = written(sample.mapInArrow(_grams(wanted), "toxic int, grams array<long>"), "grams")
    forget(sample)
    counted = held.select("toxic", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter("a + b > 2")
    other, toxic = map(float, n)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (other + toxic) * F.pow(a * (other - b) - b * (toxic - a), F.lit(2.0)) / (toxic * other * (a + b) * (other + toxic - a - b))
    best = counted.withColumn("chi", F.when(a + b < other + toxic, chi)).filter("chi > 0").orderBy(F.desc("chi"), "gram").limit(features).collect()
    grams = np.array([r.gram for r in best], np.int64).view(np.uint64)
    order = np.argsort(grams)
    grams, a, b = grams[order], np.array([r.a for r in best], np.int64)[order], np.array([r.b for r in best], np.int64)[order]
    got = sorted((r.toxic, bytes(r.numbers)) for r in held.mapInArrow(_numbers(grams), "toxic int, numbers binary").collect())
    forget(held)
    rows_of = [np.frombuffer(x, np.uint16) for _, x in got]
    weights, bias = logistic(rows_of, np.array([label for label, _ in got]), log_ratio(a, b, *n[::-1]), penalty)
    return Model(grams, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(batch.column("text").to_pylist()))], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def reject_toxic(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """docs without the rows that score at_least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist()) < at_least))

    return docs.mapInArrow(run, docs.schema)
