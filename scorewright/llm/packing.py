"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A round adds `window * share` tokens to each queue's deficit; a queue whose deficit
reaches its unit (that quantum, or `min_piece` if that is more) is served whole units and keeps the rest of
the deficit for later rounds. The service order of all rounds is one stream, cut into windows of `window` tokens, so only the
last window has padding and every window holds the target proportions to within one unit a source, whichever
partition its tokens come from.

How much a queue has been served after a round is a closed form of the round, so the place of any token in the stream
follows from its place in its queue: no task sees more than its own documents, and a source with a third of all rows is no
different from the others. Places in the queues come from prefix sums: each task writes its documents' running counts
with their ids, and the sums over (task, source) give each task's start in each queue.

Defined results: null text is an empty text (one end id); null source is a source of its own; repeated rows are packed once
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import small_enough, written
from .tokens import WordTokenizer

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"
#: Rows of Arrow batches that are worked on at once; bounds a worker's memory.
STEP = 256
#: Rows of the (task, source) table up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def _counted(path: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tok, served = TaskContext.get().partitionId(), None, {}
        for whole in batches:
            tok = tok or WordTokenizer(path, end_id)
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                ids = [np.frombuffer(tok.raw(t.as_py()), tok.dtype).astype(dtype).tobytes() for t in batch.column("text")]
                queues, before, n = batch.column("queue").to_pylist(), [], [len(x) // np.dtype(dtype).itemsize for x in ids]
                for q, k in zip(queues, n, strict=True):
                    before.append(served.get(q, 0))
                    served[q] = before[-1] + k
                yield pa.record_batch([pa.array([part] * len(n), pa.int64()), batch.column("queue"), batch.column("source"), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), batch.column("doc_id").cast(pa.int64())], ["part", "queue", "source", "before", "n", "ids", "doc_id"])

    return run


class Rounds:
    """The closed form of deficit round-robin: totals and weights by queue."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int, min_piece: int):
        self.totals = totals.astype(np.int64)
        self.phi = window * weights / weights.sum()
        self.unit = np.minimum(window, np.maximum(np.ceil(self.phi), min_piece)).astype(np.int64)
        self.window = window

    def served(self, r: np.ndarray, s: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tokens of queue s that rounds up to r have served."""
        deficit = r * self.phi[s]
        return np.where(deficit >= self.totals[s], self.totals[s], np.floor(deficit / self.unit[s]).astype(np.int64) * self.unit[s])

    def place(self, s: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in the stream of tokens `first` of queues s, each in a unit that ends before `end`."""
        r = np.ceil(end / self.phi[s])
        while (late := self.served(r, s) < end).any():
            r = r + late
        while (soon := self.served(r - 1, s) >= end).any():
            r = r - soon
        rounds, back = np.unique(r, return_inverse=True)
        out = np.empty(len(s), np.int64)
        step = max(1, 2_000_000 // len(self.totals))
        order = np.argsort(back, kind="stable")
        edges = np.searchsorted(back[order], np.arange(0, len(rounds) + step, step))
        for i, at in enumerate(range(0, len(rounds), step)):
            block = rounds[at : at + step, None]
            before, after = self.served(block - 1), self.served(block)
            ahead = np.cumsum(after - before, axis=1) - (after - before) + before.sum(axis=1)[:, None]
            mine = order[edges[i] : edges[i + 1]]
            row = back[mine] - at
            out[mine] = ahead[row, s[mine]] + first[mine] - before[row, s[mine]]
        return out


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated n times each, and the number of the repeat."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def cut(rounds: Rounds, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the stretches [a, b) of queues s: row, start in the row, length, place in the stream; none crosses a window."""
    u, w = rounds.unit[s], rounds.window
    row, k = _spread((b - 1) // u - a // u + 1)
    j = (a // u)[row] + k
    first = np.maximum(a[row], j * u[row])
    end = np.minimum(b[row], (j + 1) * u[row])
    place = rounds.place(s[row], first, np.minimum((j + 1) * u[row], rounds.totals[s[row]]))
    more, k = _spread((place + end - first - 1) // w - place // w + 1)
    lo = np.maximum(place[more], (place[more] // w + k) * w)
    hi = np.minimum((place + end - first)[more], (place[more] // w + k + 1) * w)
    row, start = row[more], (first - a[row])[more] + lo - place[more]
    joined = (row[1:] == row[:-1]) & (start[1:] == (start + hi - lo)[:-1]) & (lo[1:] == hi[:-1]) & (lo[1:] % w != 0)
    head = np.concatenate([[True], ~joined])
    group = np.cumsum(head) - 1
    length = np.bincount(group, weights=hi - lo).astype(np.int64)
    return row[head], start[head], length, lo[head]


def _pieces(names: list[str], totals: list[int], weights: list[float], window: int, min_piece: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {q: i for i, q in enumerate(names)}
        rounds = Rounds(np.array(totals), np.array(weights, float), window, min_piece)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                n, a = batch.column("n").to_numpy(), batch.column("first").to_numpy()
                queues, sources = batch.column("queue").to_pylist(), batch.column("source")
                row, start, length, place = cut(rounds, np.array([number[q] for q in queues]), a, a + n)
                raw = [np.frombuffer(x.as_py(), dtype).astype("<u4").tobytes() for x in batch.column("ids")]
                ids = [raw[r][4 * i : 4 * (i + k)] for r, i, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(place // window), pa.array(place % window), sources.take(pa.array(row))], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, weights: dict[str | None, float] | None = None, min_piece: int = 256, max_queues: int = 4096) -> DataFrame:
    """Pack docs (doc_id, text, source) into sequences of `window` ids; a row for each piece, ids as little-endian unsigned 32-bit.

    weights: target share of each source (1 for a source that it lacks); None takes each source's own share of all tokens, so no queue runs
    dry before the others. With more than max_queues sources, those that weights names keep queues of their own and the rest are dealt by
    hash over as many as are left (one at least), which bounds the table of queues; such a queue weighs as much as its sources together.
    """
    if min_piece > window:
        raise ValueError("min_piece is larger than the window")
    dtype = WordTokenizer(tokenizer).dtype.str
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    key = F.coalesce(F.concat(F.lit("v"), "source"), F.lit("w"))  # a null source last
    named = {"w" if name is None else f"v{name}": float(x) for name, x in (weights or {}).items()}
    hashed = not small_enough(rows.select("source").distinct(), max_queues)
    if hashed:
        bucket = F.format_string("q%d", F.pmod(F.xxhash64("source"), F.lit(max(1, max_queues - len(named)))))
        key = F.when(key.isin(list(named)), key).otherwise(bucket) if named else bucket
    rows = rows.withColumn("queue", key)
    kept = written(rows.mapInArrow(_counted(tokenizer, end_id, dtype), "part long, queue string, source string, before long, n long, ids binary, doc_id long"), "tokens")
    tasks = written(kept.groupBy("part", "queue").agg(F.sum("n").alias("tokens")), "tasks")
    queues = sorted((r.queue, r.total) for r in tasks.groupBy("queue").agg(F.sum("tokens").alias("total")).collect())
    starts = tasks.select("part", "queue", (F.sum("tokens").over(Window.partitionBy("queue").orderBy("part")) - F.col("tokens")).alias("base"))
    if small_enough(tasks, BROADCAST_ROWS):
        starts = F.broadcast(starts)
    placed = kept.join(starts, ["part", "queue"]).select("doc_id", "source", "queue", "n", "ids", (F.col("base") + F.col("before")).alias("first"))
    if hashed and weights is not None:
        dealt = kept.select("queue", "source").distinct().filter(F.col("queue").startswith("q")).groupBy("queue").count()
        named |= {r.queue: float(r["count"]) for r in dealt.collect()}
    share = [float(t) if weights is None else named.get(queue, 1.0) for queue, t in queues]
    if any(x <= 0 for x in share):
        raise ValueError("a weight is not above zero")
    return placed.mapInArrow(_pieces([x[0] for x in queues], [x[1] for x in queues], share, window, min_piece, dtype), PIECES)
