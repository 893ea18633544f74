"""Session builder with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "scorewright", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE, skew-join splitting and UTC; the number of shuffle partitions is left to AQE on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
