"""Task plug-ins: a task prepares samples, meets predictions, scores rows and aggregates them, all as lazy DataFrames."""

from __future__ import annotations

import importlib
import json
import pkgutil
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.choice import choice_prediction
from ..functions.text import normalize_answer, normalize_transcript
from ..operators import aggregates, structured
from ..operators.mapping import freeform_rows, labelled_choices, structured_rows
from . import retries

Step = Callable[[DataFrame], DataFrame]
#: samples -> predictions (id, prediction, error ...). The default joins a table of predictions.
Predictor = Callable[[DataFrame], DataFrame]


def same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class TaskSpec:
    name: str
    score: Step
    aggregate: Step
    prepare: Step = same
    artifacts: Callable[[DataFrame], dict[str, DataFrame]] | None = None  # scored rows -> further tables
    setup: Callable[[], None] | None = None
    teardown: Callable[[], None] | None = None


@dataclass
class Evaluation:
    samples: DataFrame
    metrics: DataFrame
    artifacts: dict[str, DataFrame] = field(default_factory=dict)


def from_table(predictions: DataFrame, key: str = "id") -> Predictor:
    """Predictions by id; a sample without one is an error, never a row lost."""

    def predict(samples: DataFrame) -> DataFrame:
        met = samples.join(predictions, key, "left")
        error = F.col("error") if "error" in predictions.columns else F.lit(None).cast("string")
        return met.withColumn("error", F.when(F.col("prediction").isNull() & error.isNull(), "no_prediction").otherwise(error))

    return predict


def from_function(function: Callable[[list[str]], list[str | None]], batch_rows: int = 20, partitions: int | None = None, column: str = "text", attempts: int = 3, decision: retries.Decision = retries.decide) -> Predictor:
    """A model call on batches of texts inside Arrow batches; `partitions` bounds how many calls run at once.

    A batch that fails in all its attempts is called once more row by row, so that only the rows that are at fault become errors (error, error_type).
    """

    def predict(samples: DataFrame) -> DataFrame:
        from pyspark.sql import types as T

        schema = T.StructType([*samples.schema.fields, *(T.StructField(n, T.StringType()) for n in ("prediction", "error", "error_type"))])

        def run(batches):
            import pyarrow as pa

            for whole in batches:
                for at in range(0, whole.num_rows, batch_rows):
                    part = whole.slice(at, batch_rows)
                    texts = part.column(part.schema.get_field_index(column)).to_pylist()
                    out, error, kind = retries.attempted(lambda texts=texts: list(function(texts)), attempts, decision)
                    if error is None:
                        found = [(x, None, None) for x in out]
                    elif len(texts) == 1:
                        found = [(None, error, kind)]
                    else:
                        found = [retries.attempted(lambda t=t: list(function([t]))[0], 1, decision) for t in texts]
                    yield pa.record_batch([*part.columns, *(pa.array(x, pa.string()) for x in zip(*found, strict=True))], [*part.schema.names, "prediction", "error", "error_type"])

        rows = samples.repartition(partitions) if partitions else samples
        return rows.mapInArrow(run, schema)

    return predict


def evaluate(spec: TaskSpec, samples: DataFrame, predict: Predictor) -> Evaluation:
    if spec.setup:
        spec.setup()
    try:
        scored = spec.score(predict(spec.prepare(samples)))
        return Evaluation(scored, spec.aggregate(scored), spec.artifacts(scored) if spec.artifacts else {})
    finally:
        if spec.teardown:
            spec.teardown()


def _valid(df: DataFrame) -> DataFrame:
    error = F.col("error").isNull() if "error" in df.columns else F.lit(True)
    return df.withColumn("valid", error & F.col("prediction").isNotNull())


def classification(name: str, labels: dict[str, str], label: str = "expected", strict: bool = True) -> TaskSpec:
    """Labels are the choices in sorted order; an answer that is no choice is invalid."""

    def score(df: DataFrame) -> DataFrame:
        index = choice_prediction("prediction", "choices", "choice_labels", "label_to_index", strict)
        error = F.col("error").isNull() if "error" in df.columns else F.lit(True)
        return df.withColumn("predicted_index", index).withColumn("valid", error & F.col("predicted_index").isNotNull()).withColumn("correct", F.coalesce(F.col("predicted_index") == F.col("expected"), F.lit(False)))

    return TaskSpec(name, score, aggregates.choice_accuracy, lambda df: labelled_choices(df, label, labels))


def freeform(name: str, metrics: tuple[str, ...] = ("exact_match", "f1"), case_sensitive: bool = False) -> TaskSpec:
    """Both sides normalized, then the row metrics of the registry."""

    def score(df: DataFrame) -> DataFrame:
        p, e = normalize_answer("prediction", case_sensitive), normalize_answer("expected", case_sensitive)
        ready = _valid(df).withColumns({"_p": p, "_e": e})
        return ready.withColumns({m: F.when(F.col("valid"), M.REGISTRY[m].row(F.col("_p"), F.col("_e"))) for m in metrics}).drop("_p", "_e")

    return TaskSpec(name, score, lambda df: aggregates.means_over_valid(df, list(metrics)), freeform_rows)


def transcription(name: str) -> TaskSpec:
    def score(df: DataFrame) -> DataFrame:
        ready = _valid(df).withColumns({"_p": normalize_transcript("prediction"), "_e": normalize_transcript("expected")})
        return ready.withColumns({m: F.when(F.col("valid"), M.REGISTRY[m].row(F.col("_p"), F.col("_e"))) for m in ("wer", "cer", "exact_match")}).drop("_p", "_e")

    return TaskSpec(name, score, aggregates.transcription)


def translation(name: str) -> TaskSpec:
    """Sentence BLEU and chrF; a neural score is a further metric of the registry where there is a model."""

    def score(df: DataFrame) -> DataFrame:
        ready = _valid(df)
        return ready.withColumns({m: F.when(F.col("valid") & (F.col("prediction") != "") & (F.col("expected") != ""), M.REGISTRY[m].row(F.col("prediction"), F.col("expected"))) for m in ("bleu", "chrf")})

    return TaskSpec(name, score, lambda df: aggregates.translation_hierarchy(df, ["bleu", "chrf"]))


def structured_extraction(name: str, schema: dict[str, Any] | None = None, rules: structured.StructuredRules = structured.StructuredRules()) -> TaskSpec:
    """One schema for all samples, or each sample's own in its column `schema`; the fields table and its diagnostics are artifacts."""
    fields: dict[str, DataFrame] = {}

    def score(df: DataFrame) -> DataFrame:
        samples, fields["fields"] = structured.score_samples(df, schema, rules)
        return samples

    def more(_: DataFrame) -> dict[str, DataFrame]:
        return {"fields": fields["fields"], "field_diagnostics": structured.field_diagnostics(fields["fields"])}

    return TaskSpec(name, score, structured.dataset_rollup, lambda df: structured_rows(df, None if schema is None else json.dumps(schema)), more)


KINDS: dict[str, Callable[..., TaskSpec]] = {"classification": classification, "freeform": freeform, "transcription": transcription, "translation": translation, "structured": structured_extraction}


def ad_hoc(kind: str, name: str, **options: Any) -> TaskSpec:
    """A task by its type alone; an unknown type raises."""
    if kind not in KINDS:
        raise ValueError(f"unknown task type {kind}")
    return replace(KINDS[kind](name, **options), name=name)


@dataclass(frozen=True)
class TaskGroup:
    """Subtasks that share resources. `task` gives a subtask's spec (None: it does not fit and is skipped), or `run` does all of it; the other hooks are optional."""

    name: str
    task: Callable[[str, Any], TaskSpec | None] | None = None
    run: Callable[[str, Any], Evaluation | None] | None = None
    subtasks: tuple[str, ...] = ()
    setup: Callable[[], Any] | None = None
    teardown: Callable[[Any], None] | None = None
    aggregate: Callable[[dict[str, Evaluation]], Any] | None = None
    write_summary: Callable[[Any, dict[str, Evaluation]], None] | None = None


@dataclass
class GroupResult:
    subtasks: dict[str, Evaluation] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)
    aggregated: Any = None


def run_group(group: TaskGroup, samples: Callable[[str], DataFrame], predict: Predictor, wanted: Iterable[str] | None = None) -> GroupResult:
    """All wanted subtasks with what setup made; a subtask that raises is an error of its own, and teardown always comes."""
    if (group.task is None) == (group.run is None):
        raise ValueError("a group has either task or run")
    out, shared = GroupResult(), group.setup() if group.setup else None
    try:
        for name in group.subtasks if wanted is None else wanted:
            try:
                if group.run:
                    found = group.run(name, shared)
                else:
                    spec = group.task(name, shared)
                    found = evaluate(spec, samples(name), predict) if spec else None
            except Exception as e:
                out.errors[name] = f"{type(e).__name__}: {e}"
                continue
            if found is None:
                out.skipped.append(name)
            else:
                out.subtasks[name] = found
        if group.aggregate and out.subtasks:
            out.aggregated = group.aggregate(out.subtasks)
        if group.write_summary and out.subtasks:
            group.write_summary(out.aggregated, out.subtasks)
        return out
    finally:
        if group.teardown:
            group.teardown(shared)


def adapters(package: Any) -> list[str]:
    """Names of the modules of a package of adapters, without its base and private ones."""
    return sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name != "base" and not m.name.startswith("_"))


def adapter(package: Any, name: str, model: str, options: dict[str, Any]) -> Any:
    """The `Adapter` of that module for a model; an unknown name raises with those there are."""
    if name not in adapters(package):
        raise ValueError(f"unknown adapter {name}; there are {', '.join(adapters(package)) or 'none'}")
    return importlib.import_module(f"{package.__name__}.{name}").Adapter(model, options)
