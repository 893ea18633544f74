"""Scoring of structured extractions: flatten, align, compare, roll up to rows, fields and a data set.

Field results are a long table (sample_id, field, ...), so a sample with very many fields is many rows, not one large value.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions.similarity import STRICT, USUAL, Thresholds, compare_typed, f1, ratio
from ..functions.text import digits_only, normalize_freeform, normalize_string
from .joins import align_fields
from .ranking import quantiles


@dataclass(frozen=True)
class StructuredRules:
    """Options of the scoring. Patterns of paths: `[]` any index, `*` anything. Weights are those of the composite scores."""

    ignored: tuple[str, ...] = ()
    numeric_strings: tuple[str, ...] = ()
    critical_strings: tuple[str, ...] = ()
    reliable: tuple[str, ...] = ()
    freeform: tuple[str, ...] = ()
    unordered: dict[str, tuple[str, ...]] = field(default_factory=dict)  # array path -> key fields
    abbreviations: dict[str, str] = field(default_factory=dict)
    sort_words: bool = False
    partial_credit: float = 0.3
    strict: bool = False
    count_ignored: bool = False  # whether ignored fields still count in the denominators
    quality_weights: tuple[float, float, float] = (0.15, 0.70, 0.15)  # validity, F1, no hallucination
    document_weights: dict[str, float] = field(default_factory=dict)
    penalty_each: float = 0.02
    penalty_most: float = 0.20

    @property
    def thresholds(self) -> Thresholds:
        return STRICT if self.strict else USUAL


def path_regex(pattern: str) -> str:
    out = "".join(r"\[\d+\]" if p == "[]" else ".*" if p == "*" else re.escape(p) for p in re.split(r"(\[\]|\*)", pattern))
    return f"^{out}$"


def matches_any(path: Column, patterns: tuple[str, ...]) -> Column:
    return path.rlike("|".join(map(path_regex, patterns))) if patterns else F.lit(False)


def tier(path: Column, rules: StructuredRules) -> Column:
    return F.when(matches_any(path, rules.reliable), "reliable").when(matches_any(path, rules.freeform), "freeform").otherwise("unclassified")


def flattened(df: DataFrame, ident: str, column: str) -> DataFrame:
    """(sample_id, field, value, kind, type) of a JSON text column."""
    rows = df.select(F.col(ident).alias("sample_id"), F.explode(jsons.flatten_json(F.col(column))).alias("f"))
    return rows.select("sample_id", "f.*")


def compare_fields(predicted: DataFrame, expected: DataFrame, rules: StructuredRules = StructuredRules(), latin_only: bool = False) -> DataFrame:
    """Tables (sample_id, field, value, kind, type) -> status, match_type, score, type_match, severity, is_numeric, tier, predicted, expected."""
    side = lambda d, s: d.select("sample_id", "field", *(F.col(c).alias(f"{s}_{c}") for c in ("value", "kind", "type")))
    keep = ~matches_any(F.col("field"), rules.ignored)
    met = align_fields(side(predicted.filter(keep), "p"), side(expected.filter(keep), "e"), ["sample_id", "field"]).withColumn("tier", tier(F.col("field"), rules))
    p, e, path = F.col("p_value"), F.col("e_value"), F.col("field")
    usual = lambda x: normalize_string(x, latin_only=latin_only)
    loose = lambda x: normalize_freeform(x, rules.abbreviations, rules.sort_words, latin_only)
    if rules.freeform:
        free = F.col("tier") == "freeform"
        met = met.withColumns({"p_norm": F.when(free, loose(p)).otherwise(usual(p)), "e_norm": F.when(free, loose(e)).otherwise(usual(e))})
    else:
        met = met.withColumns({"p_norm": usual(p), "e_norm": usual(e)})
    compared = compare_typed(p, F.col("p_kind"), e, F.col("e_kind"), F.col("p_norm"), F.col("e_norm"), rules.thresholds)
    numeric_string, critical = matches_any(path, rules.numeric_strings), matches_any(path, rules.critical_strings)
    same_digits = F.coalesce((digits_only(p) != "") & (digits_only(p) == digits_only(e)), F.lit(False))
    as_digits = F.struct(F.when(same_digits, "exact").otherwise("incorrect").alias("match_type"), same_digits.cast("double").alias("score"), F.when(same_digits, "none").otherwise("critical").alias("severity"))
    harsher = F.struct(compared.match_type.alias("match_type"), compared.score.alias("score"), F.when(critical & (F.col("e_kind") == "string") & (F.col("p_kind") == "string") & (compared.match_type != "exact"), "critical").otherwise(compared.severity).alias("severity"))
    met = met.withColumn("c", F.when(F.col("status") == "matched", F.when(numeric_string, as_digits).otherwise(harsher)))
    known = F.when(F.col("status") == "spurious", F.col("p_kind")).otherwise(F.col("e_kind"))
    is_numeric = (known == "number") | (numeric_string & (F.col("status") != "spurious"))
    return met.select(
        "sample_id", "field", "status", F.coalesce("c.match_type", "status").alias("match_type"), F.coalesce("c.score", F.lit(0.0)).alias("score"),
        F.coalesce((F.col("status") == "matched") & (F.col("p_type") == F.col("e_type")), F.lit(False)).alias("type_match"), F.coalesce("c.severity", F.lit("critical")).alias("severity"),
        is_numeric.alias("is_numeric"), "tier", p.alias("predicted"), e.alias("expected"),
    )


def sample_rollup(fields: DataFrame, rules: StructuredRules = StructuredRules(), by: list[str] | None = None, denominators: DataFrame | None = None) -> DataFrame:
    """One row a sample of the field table. denominators (by, n_expected, n_predicted) replaces the counts where ignored fields shall count."""
    by = by or ["sample_id"]
    kind = lambda k: F.count_if(F.col("match_type") == k)
    counts = {k: kind(k) for k in ("exact", "partial", "incorrect", "missed", "spurious")}
    of_tier = lambda t, k: F.count_if((F.col("tier") == t) & F.col("match_type").isin(*k))
    tiers = {f"{t}_{n}": of_tier(t, k) for t in ("reliable", "freeform") for n, k in (("exact", ("exact",)), ("partial", ("partial",)), ("expected", ("exact", "partial", "incorrect", "missed")), ("predicted", ("exact", "partial", "incorrect", "spurious")))}
    out = fields.groupBy(*by).agg(
        *(v.alias(k) for k, v in counts.items()), *(v.alias(k) for k, v in tiers.items()),
        F.count_if("type_match").alias("type_correct"), F.count_if(F.col("severity") == "critical").alias("critical_error_count"), F.count_if(F.col("severity") == "minor").alias("minor_error_count"),
        F.count_if("is_numeric").alias("numeric_fields_total"), F.count_if(F.col("is_numeric") & (F.col("match_type") == "exact")).alias("numeric_fields_correct"),
    )
    if rules.count_ignored and denominators is not None:
        out = out.join(denominators, by)
    else:
        out = out.withColumns({"n_expected": F.expr("exact + partial + incorrect + missed"), "n_predicted": F.expr("exact + partial + incorrect + spurious")})
    n_e, n_p, c = F.col("n_expected"), F.col("n_predicted"), rules.partial_credit
    good = F.col("exact") + c * F.col("partial")
    out = out.withColumns(
        {
            "field_precision_partial": ratio(good, n_p), "field_recall_partial": ratio(good, n_e), "field_precision_strict": ratio(F.col("exact"), n_p), "field_recall_strict": ratio(F.col("exact"), n_e),
            "type_accuracy": ratio(F.col("type_correct"), n_e), "hallucination_rate": ratio(F.col("spurious"), n_p), "critical_error_rate": ratio(F.col("critical_error_count"), n_e), "field_accuracy_score": ratio(F.col("exact"), n_e),
            "numeric_precision_rate": F.when(F.col("numeric_fields_total") == 0, 1.0).otherwise(ratio(F.col("numeric_fields_correct"), F.col("numeric_fields_total"))),
        }
    )
    out = out.withColumns({"field_f1_partial": f1(F.col("field_precision_partial"), F.col("field_recall_partial")), "field_f1_strict": f1(F.col("field_precision_strict"), F.col("field_recall_strict"))})
    for t in ("reliable", "freeform"):
        right = F.col(f"{t}_exact") + c * F.col(f"{t}_partial")
        out = out.withColumn(f"{t}_f1_partial", F.when(F.col(f"{t}_expected") == 0, -1.0).otherwise(f1(ratio(right, F.col(f"{t}_predicted")), ratio(right, F.col(f"{t}_expected")))))
    return out.drop(*tiers)


def quality_score(rules: StructuredRules = StructuredRules(), validity: Column | str = "schema_validity") -> Column:
    v, w, h = rules.quality_weights
    return v * (F.col(validity) if isinstance(validity, str) else validity) + w * F.col("field_f1_partial") + h * (1 - F.col("hallucination_rate"))


def document_score(rules: StructuredRules = StructuredRules()) -> Column:
    """0.50 numeric precision, 0.35 F1, 0.15 validity; explicit weights stand alone, and that of an absent tier is passed over."""
    parts = {
        "numeric_precision_rate": F.col("numeric_precision_rate"), "numeric_precision": F.col("numeric_precision_rate"), "field_f1_partial": F.col("field_f1_partial"), "schema_validity": F.col("schema_validity"),
        "inverted_hallucination": 1 - F.col("hallucination_rate"), "inverted_critical_error_rate": 1 - F.col("critical_error_rate"), "reliable_f1_partial": F.greatest(F.lit(0.0), F.col("reliable_f1_partial")),
    }
    weights = rules.document_weights or {"numeric_precision_rate": 0.50, "field_f1_partial": 0.35, "schema_validity": 0.15}
    total = F.lit(0.0)
    for name, w in weights.items():
        if name in parts:
            total = total + w * parts[name]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def _prepare(schema: dict | None, rules: StructuredRules):
    """An Arrow UDF of (predicted, expected, schema) JSON texts: normalized and aligned texts, validity, exactness, changes. Without a schema for all, the rows' own are taken."""

    seen: dict[str | None, tuple[dict, bool, str]] = {}

    def known(text: str | None) -> tuple[dict, bool, str]:
        if text in seen:
            return seen[text]
        own = jsons.unwrap_schema((json.loads(text) if text else {}) if schema is None else schema)
        own = own if isinstance(own, dict) else {}
        found = own, not own.get("properties"), jsons.fingerprint(own)
        if len(seen) < 1024:
            seen[text] = found
        return found

    def align(p, e, path=""):
        if path in rules.unordered and isinstance(p, list) and isinstance(e, list):
            keys = rules.unordered[path]
            key = lambda x: json.dumps([x.get(k) if isinstance(x, dict) else x for k in keys] if keys else x, sort_keys=True, default=str)
            by: dict[str, list] = {}
            for x in reversed(p):
                by.setdefault(key(x), []).append(x)
            first = [by[key(x)].pop() for x in e if by.get(key(x))]
            return first + sorted((x for left in by.values() for x in reversed(left)), key=key)
        if isinstance(p, dict) and isinstance(e, dict):
            return {k: align(v, e[k], f"{path}.{k}" if path else k) if k in e else v for k, v in p.items()}
        return p

    @F.pandas_udf("predicted string, expected string, valid boolean, exact boolean, null_words int, date_words int, schema_fingerprint string")
    def run(p: pd.Series, e: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, text in zip(p, e, s, strict=True):
            own, blank, mark = known(text)
            ok, x = jsons._parsed(a)
            _, y = jsons._parsed(b)
            found: list[str] = []
            x, y = jsons.normalized(x, own, True, "", found), jsons.normalized(y, own, False)
            x = align(x, y) if ok else x
            good = ok and (isinstance(x, dict) if blank else jsons.valid(x, own))
            rows.append((json.dumps(x) if good else None, json.dumps(y), good, good and jsons.equal_values(x, y), found.count("null"), found.count("date"), mark))
        return pd.DataFrame(rows, columns=["predicted", "expected", "valid", "exact", "null_words", "date_words", "schema_fingerprint"])

    return run


def score_samples(df: DataFrame, schema: dict | None, rules: StructuredRules = StructuredRules(), prediction: str = "prediction", expected: str = "expected", ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """(samples, fields): normalize, align, validate, flatten, compare and roll up. Samples keep error, if there, as invalid; invalid ones score 0.

    schema None: each row's own, JSON text in its column `schema`; fields then carry its fingerprint, so that diagnostics see whether there is one schema.
    """
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    kind = F.col("error_type") if "error_type" in df.columns else F.lit(None).cast("string")
    own = F.col("schema") if schema is None and "schema" in df.columns else F.lit(None).cast("string")
    ready = df.select(F.col(ident).alias("sample_id"), error.alias("error"), kind.alias("error_type"), _prepare(schema, rules)(F.when(error.isNull(), F.col(prediction)), F.col(expected), own).alias("s")).select("sample_id", "error", "error_type", "s.*")
    good = ready.filter("valid")
    p, e = flattened(good, "sample_id", "predicted"), flattened(good, "sample_id", "expected")
    fields = compare_fields(p, e, rules)
    if schema is None:
        fields = fields.join(good.select("sample_id", "schema_fingerprint"), "sample_id")
    count = lambda d, name: d.groupBy("sample_id").agg(F.count("*").alias(name))
    whole = count(e, "n_expected").join(count(p, "n_predicted"), "sample_id", "full_outer").fillna(0) if rules.count_ignored else None
    rolled = sample_rollup(fields, rules, denominators=whole)
    met = ready.select("sample_id", "error", "error_type", "valid", "exact", "null_words", "date_words", "schema_fingerprint").withColumnRenamed("exact", "exact_match").join(rolled, "sample_id", "left")
    scores = [n for n, t in rolled.dtypes if n != "sample_id" and t in ("double", "bigint")]
    met = met.fillna(0, scores).withColumn("schema_validity", F.col("valid").cast("double"))
    penalty = jsons.null_penalty("null_words", rules.penalty_each, rules.penalty_most)
    scaled = lambda s: F.when(F.col("valid"), F.greatest(F.lit(0.0), s - penalty)).otherwise(0.0)
    return met.withColumns({"extraction_quality_score": scaled(quality_score(rules)), "document_extraction_score": scaled(document_score(rules))}), fields


#: Metrics of samples that a data set averages over its valid rows.
AVERAGED = (
    "field_f1_partial", "field_f1_strict", "field_precision_partial", "field_recall_partial", "field_precision_strict", "field_recall_strict", "type_accuracy", "extraction_quality_score",
    "document_extraction_score", "critical_error_rate", "field_accuracy_score",
)


def dataset_rollup(samples: DataFrame, by: list[str] | None = None, rules: StructuredRules = StructuredRules()) -> DataFrame:
    """Validity, hallucination, exactness and kinds of errors over all rows; F1 and the scores over valid ones (0 without any), and what follows from them.

    A tier that no valid row has is null; without rows that have numbers, numeric precision is 1, and without imperfect ones their quality.
    """
    ok, c, have = F.col("valid"), F.col, set(samples.columns)
    zero = F.lit(0.0)
    over = lambda m, test=None: F.avg(F.when(ok if test is None else ok & test, c(m)))
    kind = lambda k: F.avg((F.coalesce(c("error_type"), F.lit("")) == k).cast("double")) if "error_type" in have else zero
    valid, imperfect = F.count_if(ok), ok & ~c("exact_match")
    among = lambda found, none: F.when(valid == 0, zero).otherwise(F.coalesce(found, F.lit(none)))
    spread = lambda m, at: [f(F.when(ok, c(m))).alias(f"{at}_{n}") for n, f in (("mean", F.avg), ("stdev", F.stddev_samp), ("min", F.min), ("max", F.max))]
    out = samples.groupBy(*(by or [])).agg(
        F.count("*").alias("total_samples"), valid.alias("valid_samples"), F.count("error").alias("error_count"), F.coalesce(F.avg(c("error").isNotNull().cast("double")), zero).alias("error_rate"),
        kind("connectivity_error").alias("connectivity_error_rate"), kind("invalid_response").alias("invalid_response_rate"),
        F.avg(ok.cast("double")).alias("schema_validity_rate"), F.avg("hallucination_rate").alias("hallucination_rate"), F.avg(c("exact_match").cast("double")).alias("exact_match_rate"),
        *(F.coalesce(over(m), zero).alias(m) for m in AVERAGED if m in have),
        among(over("numeric_precision_rate", c("numeric_fields_total") > 0), 1.0).alias("numeric_precision_rate"),
        *(F.coalesce(F.sum(F.when(ok, c(m))), F.lit(0)).alias(m) for m in ("numeric_fields_total", "numeric_fields_correct") if m in have),
        *(over(m, c(m) >= 0).alias(m) for m in ("reliable_f1_partial", "freeform_f1_partial") if m in have),
        among(F.avg(F.when(imperfect, c("extraction_quality_score"))), 1.0).alias("imperfect_sample_quality"), among(F.avg(F.when(imperfect, c("field_f1_partial"))), 1.0).alias("imperfect_sample_quality_f1"), F.count_if(imperfect).alias("imperfect_sample_count"),
        *spread("extraction_quality_score", "eqs"), *spread("field_f1_partial", "f1"),
        F.coalesce(F.avg(F.when(ok, jsons.null_penalty("null_words", rules.penalty_each, rules.penalty_most))), zero).alias("normalization_penalty"), F.sum("null_words").alias("null_string_conversions"),
        *([F.sum("date_words").alias("date_format_conversions")] if "date_words" in have else []),
        *(F.coalesce(F.sum(F.when(ok, c(m))), F.lit(0)).alias(f"{m}_count") for m in ("exact", "partial", "incorrect", "missed", "spurious")),
    )
    out = out.fillna(0.0, [f"{at}_{n}" for at in ("eqs", "f1") for n in ("mean", "stdev", "min", "max")])
    return out.withColumns({"response_rate": 1 - c("connectivity_error_rate"), "overall_extraction_quality_score": c("extraction_quality_score") * (1 - c("invalid_response_rate"))})


def match_distribution(fields: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(match_type, count, percent)."""
    counted = fields.groupBy(*(by or []), "match_type").agg(F.count("*").alias("count"))
    total = counted.groupBy(*(by or [])).agg(F.sum("count").alias("n"))
    met = counted.join(total, by) if by else counted.join(F.broadcast(total))  # one row
    return met.select(*(by or []), "match_type", "count", (100.0 * ratio(F.col("count"), F.col("n"))).alias("percent"))


def composite_stats(fields: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation and ends of the scores above 0; a single score has deviation 0."""
    by = by or []
    named = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]
    rows = fields.select(*named, F.when(F.col("score") > 0, F.col("score")).alias("_s"))
    keys, zero = [f"_g{i}" for i in range(len(by))], F.lit(0.0)
    spread = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.coalesce(F.avg("_s"), zero).alias("mean"), F.coalesce(F.stddev_samp("_s"), zero).alias("stdev"))
    middle = quantiles(rows, "_s", (0.5,), keys or None)
    met = middle.join(spread, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))) if keys else middle.join(F.broadcast(spread))  # one row
    return met.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), "n", "mean", F.coalesce(F.get("q", F.lit(0)), zero).alias("median"), "stdev", F.coalesce("min", zero).alias("min"), F.coalesce("max", zero).alias("max"))


def error_kind() -> Column:
    """The kind of a field's error, null if it has none."""
    m = F.col("match_type")
    return F.when(m == "exact", F.lit(None).cast("string")).when(m.isin("missed", "spurious", "partial"), m).when(~F.col("type_match"), "type_mismatch").otherwise("wrong_value")


def field_diagnostics(fields: DataFrame, collapse_indexes: bool = False, examples: int = 3, one_schema: bool = True) -> DataFrame:
    """Counts, rates and quality band a field, with a few examples of errors; with several schema fingerprints, none if one_schema."""
    if one_schema and "schema_fingerprint" in fields.columns and fields.select("schema_fingerprint").distinct().limit(2).count() > 1:
        fields = fields.limit(0)
    if collapse_indexes:
        fields = fields.withColumn("field", F.regexp_replace("field", r"\[\d+\]", "[*]"))
    kind, m = error_kind(), F.col("match_type")
    n_e, n = F.count_if(m != "spurious"), F.count("*")
    # The smallest few examples are kept by aggregation of fixed size, however many errors a field has.
    example = F.when(kind.isNotNull(), F.struct(F.col("sample_id").alias("sample_id"), kind.alias("error_type"), F.col("predicted").alias("predicted"), F.col("expected").alias("expected")))
    out = fields.groupBy("field").agg(
        n_e.alias("expected_count"), *(F.count_if(m == k).alias(f"{k}_count") for k in ("exact", "partial", "incorrect", "missed", "spurious")), F.count_if(kind == "type_mismatch").alias("type_mismatch_count"), F.count_if(kind == "wrong_value").alias("wrong_value_count"),
        ratio(F.count_if(m == "exact"), n_e).alias("exact_accuracy"), ratio(F.count_if(kind.isNotNull() & (m != "spurious")), n_e).alias("error_rate"), ratio(F.count_if(m == "spurious"), n).alias("spurious_rate"),
        F.min(example).alias("example"),
    )
    pct = 100 * F.col("exact_accuracy")
    out = out.withColumn("band", F.when(pct >= 99, "excellent").when(pct >= 80, "good").when(pct >= 60, "fair").otherwise("poor"))
    if examples <= 1:
        return out
    from pyspark.sql.window import Window

    w = Window.partitionBy("field").orderBy("sample_id", "predicted", "expected")
    top = fields.withColumn("error_type", kind).filter("error_type is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= examples)
    few = top.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("n", "sample_id", "error_type", "predicted", "expected"))).alias("examples"))
    return out.drop("example").join(few, "field", "left")


def worst_fields(diagnostics: DataFrame, k: int = 20) -> DataFrame:
    return diagnostics.filter("expected_count > 0").orderBy("exact_accuracy", F.desc("expected_count"), "field").limit(k)


def hallucinated_fields(diagnostics: DataFrame, k: int = 20) -> DataFrame:
    return diagnostics.filter("spurious_count > 0").orderBy(F.desc("spurious_count"), "field").limit(k)
