"""Incremental scoring of a stream of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M


def score_stream(predictions: DataFrame, samples: DataFrame, names: list[str], key: str = "id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream (id, prediction, ts) against static samples (id, expected): each id once within the watermark, so state is bounded."""
    first = predictions.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return M.score(first.join(samples, key), names)


def windowed_means(scored: DataFrame, names: list[str], time: str = "ts", window: str = "10 minutes") -> DataFrame:
    """Means by tumbling window; the stream needs a watermark on `time`, after which a window is final."""
    return scored.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), *(F.avg(n).alias(n) for n in names)).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", *names)


def write_scores(scored: DataFrame, path: str, checkpoint: str, **trigger):
    """Append scored rows to Parquet; the sink's own log makes a repeated batch harmless."""
    return scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(path)
