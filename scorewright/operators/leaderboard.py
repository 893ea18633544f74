"""Run results to leaderboards: unpivot, weigh, pivot, nest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import LEADERBOARD_PRIMARY, primary_metric, row_mean, word_accuracy

#: Metrics under other names: preferred name -> names it may have.
ALIASES = {"acc": ("accuracy",), "comet": ("overall_comet",)}


@dataclass(frozen=True)
class Category:
    """How a family of tasks gets its score."""

    name: str
    prefix: str
    preferred: str | None = None
    divide_by: float = 1.0
    exclude: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()


def publisher(model: Column | str) -> Column:
    m = F.col(model) if isinstance(model, str) else model
    return F.when(F.contains(m, F.lit("/")), F.split(m, "/")[0])


def short_name(model: Column | str) -> Column:
    m = F.col(model) if isinstance(model, str) else model
    return F.when(F.contains(m, F.lit("/")), F.split(m, "/")[1]).otherwise(m)


def task_scores(results: DataFrame, categories: list[Category], metrics: list[str]) -> DataFrame:
    """(model, category, task, metric, score) of rows (model, category, task, metrics...): one parametrized rule for all kinds of runs."""
    have = {m: F.col(m) for m in metrics}
    for name, others in ALIASES.items():
        known = [have[x] for x in (name, *others) if x in have]
        if known:
            have[name] = F.coalesce(*known)
    out = None
    for c in categories:
        name, value = primary_metric(have, LEADERBOARD_PRIMARY, c.preferred)
        rows = results.filter((F.col("category") == c.name) & ~F.col("task").isin(*c.exclude) if c.exclude else F.col("category") == c.name)
        rows = rows.select("model", "category", "task", name.alias("metric"), (value / c.divide_by).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter("score is not null")


def legacy_scores(results: DataFrame, keys: tuple[str, ...] = ("acc,all", "acc,none", "chrf,clean_translation"), percent: tuple[str, ...] = ("chrf,clean_translation",)) -> DataFrame:
    """(model, task, metric, score) of maps of metrics, by the first key that a task has; percentages are divided by 100."""
    get = lambda k: F.try_element_at(F.col("metrics"), F.lit(k)) / (100.0 if k in percent else 1.0)
    return results.select("model", "task", F.coalesce(*(F.when(get(k).isNotNull(), F.lit(k)) for k in keys)).alias("metric"), F.coalesce(*map(get, keys)).alias("score")).filter("score is not null")


def weighted_score(rows: DataFrame, value: str, by: list[str], weight: str = "valid_samples") -> DataFrame:
    """Weighted by samples; weights of 0 or less and null values have no part, and nothing gives null."""
    use = (F.col(weight) > 0) & F.col(value).isNotNull()
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.when(use, F.col(value) * F.col(weight))), F.sum(F.when(use, F.col(weight)).cast("double"))).alias(value))


def transcription_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Word accuracy of each row and its mean by group."""
    return rows.withColumn("word_accuracy", word_accuracy("wer")).groupBy(*by).agg(F.round(F.avg("word_accuracy"), 4).alias("score"))


def copied_folder(name: Column | str, publishers: tuple[str, ...] = ("google", "meta-llama", "qwen")) -> Column:
    """Whether a run folder is the copy of a model under `publisher__model`. The publishers."""
    n = F.col(name) if isinstance(name, str) else name
    return F.contains(n, F.lit("__")) & n.rlike("|".join(publishers))


def structured_scores(runs: DataFrame) -> DataFrame:
    """runs (model, metrics: map of aggregates, subtasks: array of (mean, valid_samples)) -> (model, task, metric, score), five rows a model.

    The main score is the overall quality, else the quality, else 0; the composite score is the subtasks' mean, weighted by samples of more than none.
    """
    get = lambda k: F.coalesce(F.try_element_at("metrics", F.lit(k)), F.lit(0.0))
    used = F.filter("subtasks", lambda s: s.mean.isNotNull() & (s.valid_samples > 0))
    total = lambda f: F.aggregate(used, F.lit(0.0), lambda a, s: a + f(s))
    composite = F.coalesce(F.try_divide(total(lambda s: s.mean * s.valid_samples), total(lambda s: s.valid_samples.cast("double"))), F.lit(0.0))
    main = F.coalesce(F.try_element_at("metrics", F.lit("overall_extraction_quality_score")), get("extraction_quality_score"))
    rows = (("extraction_quality_score", "eqs", main), ("composite_score", "composite_mean", composite), ("schema_validity", "validity_rate", get("schema_validity_rate")), ("field_f1_partial", "f1", get("field_f1_partial")), ("hallucination_rate", "hallucination_rate", get("hallucination_rate")))
    return runs.select("model", F.inline(F.array(*(F.struct(F.lit(t).alias("task"), F.lit(m).alias("metric"), s.alias("score")) for t, m, s in rows))))


def speech_scores(rows: DataFrame) -> DataFrame:
    """rows (model, task, wer, cer) -> (model, task, metric, score, wer, cer): word accuracy of each task that has a rate, and of `overall` their mean, to four places."""
    known = rows.filter(F.col("wer").isNotNull()).withColumn("score", word_accuracy("wer"))
    each = known.select("model", "task", F.lit("word_accuracy").alias("metric"), "score", F.round("wer", 4).alias("wer"), F.round(F.coalesce("cer", F.lit(0.0)), 4).alias("cer"))
    null = F.lit(None).cast("double")
    return each.unionByName(each.groupBy("model").agg(F.round(F.avg("score"), 4).alias("score")).select("model", F.lit("overall").alias("task"), F.lit("word_accuracy").alias("metric"), "score", null.alias("wer"), null.alias("cer")))


def standard_scores(rows: DataFrame, category: str, metrics: list[str], preferred: str | None = None, divide_by: float = 1.0) -> DataFrame:
    """rows (model, task, metrics...) -> (model, task, metric, score) by the preferred metric, else the first in order."""
    return task_scores(rows.withColumn("category", F.lit(category)), [Category(category, category, preferred, divide_by)], metrics).select("model", "task", "metric", "score")


#: Processors by name; an unknown name is the standard one.
PROCESSORS = {
    "standard_results_processor": standard_scores,
    "portuguese_results_processor": standard_scores,
    "translation_results_processor": lambda rows, category, metrics: standard_scores(rows, category, metrics, "chrf"),
    "structured_extraction_results_processor": structured_scores,
    "transcription_results_processor": speech_scores,
}


def processor(name: str):
    return PROCESSORS.get(name, standard_scores)


def category_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "category").agg(F.avg("score").alias("score"))


def wide(scores: DataFrame, columns: list[str] | None = None, places: int = 4) -> DataFrame:
    """One row a model, a column `<category>_<task>` each. Known columns spare the pass that finds them."""
    named = scores.withColumn("column", F.concat_ws("_", "category", "task"))
    pivot = named.groupBy("model").pivot("column", columns) if columns else named.groupBy("model").pivot("column")
    return pivot.agg(F.round(F.first("score"), places))


def with_subcategories(table: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Copies of the columns that begin with a prefix, under its new name."""
    return table.withColumns({new + c.removeprefix(old): F.col(c) for old, new in prefixes.items() for c in table.columns if c.startswith(old)})


def overall(table: DataFrame, columns: list[str], name: str = "overall_score") -> DataFrame:
    """The mean of the category columns that a model has."""
    return table.withColumn(name, F.round(row_mean(*(c for c in columns if c in table.columns)), 4))


def unpivoted(table: DataFrame, key: str = "model") -> DataFrame:
    values = [c for c in table.columns if c != key]
    return table.unpivot([key], values, "column", "score").filter("score is not null")


def breakdown(scores: DataFrame) -> DataFrame:
    """One row a model: a map from category to a map from task to score. As large as the model's tasks."""
    inner = scores.groupBy("model", "category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "score")))).alias("tasks"))
    return inner.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("category", "tasks"))).alias("categories"))


def merge_models(published: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """All models; the new row wins."""
    return new.unionByName(published.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
