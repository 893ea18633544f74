"""Aggregates of row metrics up to tasks and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import mean_or, pearson
from ..functions.text import col

#: Metrics of a task in order of preference; the second list is that of leaderboards.
PRIMARY = ("accuracy", "acc", "exact_match", "f1_macro", "pearson", "comet", "chrf", "bleu", "overall_extraction_quality_score", "extraction_quality_score", "field_f1_partial", "mse")
LEADERBOARD_PRIMARY = PRIMARY[1:]


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def choice_accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """valid and correct flags a row (null valid counts as valid): counts, accuracy of the valid rows, error rate of all."""
    ok = F.coalesce(F.col("valid"), F.lit(True))
    right, n, good = F.count_if(ok & F.coalesce(F.col("correct"), F.lit(False))), F.count("*"), F.count_if(ok)
    return df.groupBy(*(by or [])).agg(n.alias("total_samples"), good.alias("valid_samples"), right.alias("correct"), share(right, good).alias("accuracy"), (n - good).alias("error_count"), share(n - good, n).alias("error_rate"))


def means_over_valid(df: DataFrame, metrics: list[str], by: list[str] | None = None, valid_default: bool = True, missing_is_zero: bool = True) -> DataFrame:
    """Mean of each metric over the valid rows; a missing value counts as 0 or not at all."""
    ok = F.coalesce(F.col("valid"), F.lit(valid_default))
    value = lambda m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if missing_is_zero else F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))
    n, good = F.count("*"), F.count_if(ok)
    return df.groupBy(*(by or [])).agg(n.alias("total_samples"), good.alias("valid_samples"), share(n - good, n).alias("error_rate"), *(F.coalesce(F.avg(F.when(ok, value(m))), F.lit(0.0)).alias(m) for m in metrics))


def regression(df: DataFrame, prediction: str, expected: str, by: list[str] | None = None, clamp: bool = True) -> DataFrame:
    error = F.pow(F.col(prediction).cast("double") - F.col(expected).cast("double"), F.lit(2.0))
    return df.groupBy(*(by or [])).agg(mean_or(error).alias("mse"), pearson(prediction, expected, clamp).alias("pearson"), F.count("*").alias("total_samples"))


def transcription(df: DataFrame, locale: str = "locale", metrics: tuple[str, ...] = ("wer", "cer", "exact_match")) -> DataFrame:
    """Means by locale and over all (locale null, is_total true); null if every row failed, error rate to four places."""
    ok = F.coalesce(F.col("valid"), F.lit(False))
    n, good = F.count("*"), F.count_if(ok)
    out = df.groupingSets([[], [F.col(locale)]], F.col(locale)).agg(
        F.grouping(locale).cast("boolean").alias("is_total"), n.alias("sample_count"), good.alias("valid_samples"), F.round(share(n - good, n), 4).alias("error_rate"),
        *(F.avg(F.when(ok, F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")))).alias(m) for m in metrics),
    )
    return out


def translation_hierarchy(df: DataFrame, metrics: list[str], direction: str = "direction", pair: str = "language_pair", source: str = "source_language", target: str = "target_language") -> DataFrame:
    """(level, name, metric...): direction means, pair means of those, the overall mean of those, and means by language over directions."""
    ways = df.groupBy(direction, pair, source, target).agg(*(F.avg(m).alias(m) for m in metrics))
    pairs = ways.groupBy(pair).agg(*(F.avg(m).alias(m) for m in metrics))
    whole = pairs.agg(*(F.avg(m).alias(m) for m in metrics))
    tongues = ways.withColumn("language", F.explode(F.array_distinct(F.array(source, target)))).groupBy("language").agg(*(F.avg(m).alias(m) for m in metrics))
    level = lambda d, name, at: d.select(F.lit(name).alias("level"), at.alias("name"), *metrics)
    return level(ways, "direction", F.col(direction)).unionByName(level(pairs, "pair", F.col(pair))).unionByName(level(tongues, "language", F.col("language"))).unionByName(level(whole, "overall", F.lit("all")))


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value), null values left out."""
    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value").filter("value is not null")


def sample_weighted(subtasks: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Means weighted by valid_samples, else total_samples; counts are summed. A subtask of weight 0 or without the metric has no part in it."""
    w = F.coalesce(F.col("valid_samples"), F.col("total_samples"), F.lit(0)).cast("double")
    weighted = lambda m: F.try_divide(F.sum(F.when(w > 0, F.col(m).cast("double") * w)), F.sum(F.when((w > 0) & F.col(m).isNotNull(), w)))
    return subtasks.groupBy(*(by or [])).agg(F.sum("total_samples").alias("total_samples"), F.sum("valid_samples").alias("valid_samples"), *(weighted(m).alias(m) for m in metrics))


def primary_metric(metrics: dict[str, Column | str], priority: tuple[str, ...] = PRIMARY, preferred: str | None = None) -> tuple[Column, Column]:
    """Name and value of the first metric, in order, that is not null."""
    order = [m for m in ([preferred] if preferred else []) + list(priority) if m in metrics]
    name = F.coalesce(*(F.when(col(metrics[m]).isNotNull(), F.lit(m)) for m in order), F.lit(None).cast("string"))
    value = F.coalesce(*(col(metrics[m]).cast("double") for m in order), F.lit(None).cast("double"))
    return name, value


def overall_score(subtasks: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Each subtask's own primary metric, weighted by samples."""
    _, value = primary_metric({m: m for m in metrics})
    return sample_weighted(subtasks.withColumn("overall_score", value), ["overall_score"], by)


def mask_aggregate(df: DataFrame, by: list[str] | None = None, acceptable: float = 0.80) -> DataFrame:
    """Means of mask scores (iou, precision, recall, f1, accuracy, mae), `score` and the share with an acceptable IoU."""
    names = ("iou", "precision", "recall", "f1", "accuracy", "mae")
    return df.groupBy(*(by or [])).agg(*(F.avg(n).alias(n) for n in names), F.avg("f1").alias("score"), F.avg((F.col("iou") >= acceptable).cast("double")).alias("acceptable_rate"), F.count("*").alias("total_samples"))


def word_accuracy(wer: Column | str) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - col(wer)), 4)


def row_mean(*columns: Column | str) -> Column:
    """Mean of the columns that are not null."""
    values = F.filter(F.array(*(col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def class_rates(df: DataFrame, column: str = "diagnostic_class", by: list[str] | None = None) -> DataFrame:
    """(class, count, rate of all rows); rows without a class count in the rate only. One pass, no window over all rows."""
    counted = df.groupBy(*(by or []), column).agg(F.count("*").alias("count"))
    total = counted.groupBy(*(by or [])).agg(F.sum("count").alias("run_samples"))
    met = counted.join(total, by) if by else counted.join(F.broadcast(total))  # one row
    return met.filter(F.col(column).isNotNull()).withColumn("rate", share(F.col("count"), F.col("run_samples")))


def run_diagnostics(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of (class, count) tables of many tasks against their samples (run_samples a task), rates to six places."""
    tasks = counts.select("task", "run_samples", *(by or [])).distinct().groupBy(*(by or [])).agg(F.sum("run_samples").alias("run_samples"))
    summed = counts.groupBy(*(by or []), "diagnostic_class").agg(F.sum("count").alias("count"))
    met = summed.join(tasks, by) if by else summed.join(F.broadcast(tasks))  # one row
    return met.withColumn("rate", F.round(share(F.col("count"), F.col("run_samples")), 6))


def status_counts(df: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    names = ("passed", "degraded", "skipped", "failed", "error", "no_samples", "pending")
    s = F.coalesce(F.col(status), F.lit("pending"))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("requested"), *(F.count_if(s == n).alias(n) for n in names))


def throughput(df: DataFrame, seconds: float) -> DataFrame:
    return df.agg(F.count("*").alias("samples"), F.lit(float(seconds)).alias("duration_s"), share(F.count("*"), F.lit(seconds)).alias("samples_per_s"))


def distinct_warnings(df: DataFrame, column: str = "warning", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.array_sort(F.collect_set(column)).alias("warnings"))
