"""Likeness of strings, numbers and arrays, with match types and error severities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, split_words


@dataclass(frozen=True)
class Thresholds:
    exact: float = 0.95
    partial: float = 0.50
    array_partial: float = 0.50
    relative: float = 1e-3
    absolute: float = 1e-6
    token_weight: float = 0.5
    edit_weight: float = 0.3
    containment_weight: float = 0.2


USUAL = Thresholds()
STRICT = Thresholds(exact=0.98, partial=0.70, array_partial=0.70, relative=1e-4, absolute=1e-9)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def edit_similarity(p: Column | str, e: Column | str) -> Column:
    p, e = col(p), col(e)
    longer = F.greatest(F.char_length(p), F.char_length(e))
    return F.when(longer > 0, 1 - F.levenshtein(p, e) / longer.cast("double")).otherwise(0.0)


def containment(p: Column | str, e: Column | str) -> Column:
    p, e = col(p), col(e)
    return F.when(F.contains(p, e), 1.0).when(F.contains(e, p), ratio(F.char_length(p), F.char_length(e))).otherwise(0.0)


def token_set_f1(p: Column | str, e: Column | str) -> Column:
    a, b = F.array_distinct(split_words(p)), F.array_distinct(split_words(e))
    both = F.size(F.array_intersect(a, b))
    return f1(ratio(both, F.size(a)), ratio(both, F.size(b)))


def composite(p: Column | str, e: Column | str, t: Thresholds = USUAL) -> Column:
    return t.token_weight * token_set_f1(p, e) + t.edit_weight * edit_similarity(p, e) + t.containment_weight * containment(p, e)


def compare_strings(p: Column | str, e: Column | str, t: Thresholds = USUAL) -> Column:
    """(match_type, score) of normalized strings."""
    p, e = col(p), col(e)
    score = F.when(p == e, 1.0).otherwise(composite(p, e, t))
    kind = F.when((p == e) | (score >= t.exact), "exact").when(score >= t.partial, "partial").otherwise("incorrect")
    return F.struct(kind.alias("match_type"), score.alias("score"))


def close(p: Column | str, e: Column | str, t: Thresholds = USUAL) -> Column:
    p, e = col(p).cast("double"), col(e).cast("double")
    return F.abs(p - e) <= t.absolute + t.relative * F.abs(e)


def _exact_or_not(same: Column) -> Column:
    same = F.coalesce(same, F.lit(False))
    return F.struct(F.when(same, "exact").otherwise("incorrect").alias("match_type"), same.cast("double").alias("score"))


def compare_numbers(p: Column | str, e: Column | str, t: Thresholds = USUAL) -> Column:
    return _exact_or_not(close(p, e, t))


def compare_arrays(p: Column | str, e: Column | str, t: Thresholds = USUAL) -> Column:
    """Jaccard of arrays of strings; an empty expectation is met by nothing but an empty array."""
    p, e = col(p), col(e)
    score = F.when(F.size(e) == 0, (F.size(p) == 0).cast("double")).otherwise(ratio(F.size(F.array_intersect(p, e)), F.size(F.array_union(p, e))))
    kind = F.when(score == 1.0, "exact").when((F.size(e) > 0) & (score >= t.array_partial), "partial").otherwise("incorrect")
    return F.struct(kind.alias("match_type"), score.alias("score"))


def compare_typed(p: Column, p_kind: Column, e: Column, e_kind: Column, p_norm: Column, e_norm: Column, t: Thresholds = USUAL) -> Column:
    """(match_type, score, severity) of JSON values as text, with kinds null, string, number, boolean, array, object.

    Numbers and booleans are compared as numbers, as the evaluated semantics do (true is 1). Severity: strings minor; numbers,
    booleans, kinds that differ and one-sided nulls critical; arrays minor if partial.
    """
    number = lambda x, k: F.when(k == "boolean", (F.lower(x) == "true").cast("double")).otherwise(x.try_cast("double"))
    numeric = lambda k: k.isin("number", "boolean")
    items = lambda x: F.coalesce(F.transform(F.from_json(x, "array<string>"), lambda i: i), F.array().cast("array<string>"))
    text, arrays = compare_strings(p_norm, e_norm, t), compare_arrays(items(p), items(e), t)
    numbers, other = compare_numbers(number(p, p_kind), number(e, e_kind), t), _exact_or_not(p == e)
    out = lambda pair, severity: F.struct(pair.match_type.alias("match_type"), pair.score.alias("score"), severity.alias("severity"))
    unless = lambda pair, severity: F.when(pair.match_type == "exact", "none").otherwise(severity)
    nothing = _exact_or_not(F.lit(False))
    return (
        F.when((p_kind == "null") & (e_kind == "null"), out(_exact_or_not(F.lit(True)), F.lit("none")))
        .when((p_kind == "null") | (e_kind == "null"), out(nothing, F.lit("critical")))
        .when((p_kind == "string") & (e_kind == "string"), out(text, unless(text, F.lit("minor"))))
        .when(numeric(p_kind) & numeric(e_kind), out(numbers, unless(numbers, F.lit("critical"))))
        .when(p_kind != e_kind, out(nothing, F.lit("critical")))
        .when(p_kind == "array", out(arrays, unless(arrays, F.when(arrays.match_type == "partial", "minor").otherwise("critical"))))
        .otherwise(out(other, unless(other, F.lit("critical"))))
    )
