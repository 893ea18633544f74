"""Resuming a run: what has been done is a table keyed by (config_hash, sample_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "config_hash string, sample_id string, metrics string"


def load_checkpoint(spark: SparkSession, path: str, config_hash: str) -> DataFrame:
    """Rows done under this configuration; none where there is no table yet. The hash is a partition, so others are not read."""
    try:
        return spark.read.schema(SCHEMA).parquet(path).filter(F.col("config_hash") == config_hash)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def append_checkpoint(done: DataFrame, path: str, config_hash: str, sample: str = "sample_id", metrics: list[str] | None = None) -> None:
    """Append-only; a sample written twice counts once when it is read."""
    values = F.to_json(F.struct(*(metrics or [c for c in done.columns if c != sample])))
    done.select(F.lit(config_hash).alias("config_hash"), F.col(sample).cast("string").alias("sample_id"), values.alias("metrics")).write.mode("append").partitionBy("config_hash").parquet(path)


def remaining(samples: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return samples.join(done.select(F.col("sample_id").alias(key)), key, "left_anti")
