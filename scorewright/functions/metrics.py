"""Row metrics and their aggregates: exact match, token F1, WER, CER, squared error, BLEU and chrF; and a registry of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import f1, ratio
from .text import col, collapse, let, strip, tokens


def exact_match(p: Column | str, e: Column | str, case_insensitive: bool = True, stripped: bool = True) -> Column:
    """1 or 0; a null on either side is 0."""
    a, b = (col(x).cast("string") for x in (p, e))
    if stripped:
        a, b = strip(a), strip(b)
    if case_insensitive:
        a, b = F.lower(a), F.lower(b)
    return F.coalesce((a == b).cast("double"), F.lit(0.0))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Common elements of two arrays of strings, repeats counted: one sort of both together, then runs of equal elements."""
    side = lambda xs, p: F.transform(xs, lambda g: F.struct(g.alias("g"), F.lit(p).alias("p"), F.lit(1 - p).alias("r")))
    done = F.aggregate(
        F.array_sort(F.concat(side(a, 1), side(b, 0))),
        F.struct(F.lit("").alias("g"), F.lit(0).alias("p"), F.lit(0).alias("r"), F.lit(0).alias("n")),
        lambda acc, x: F.when(acc.g == x.g, F.struct(x.g.alias("g"), (acc.p + x.p).alias("p"), (acc.r + x.r).alias("r"), acc.n.alias("n"))).otherwise(F.struct(x.g.alias("g"), x.p.alias("p"), x.r.alias("r"), (acc.n + F.least(acc.p, acc.r)).alias("n"))),
        lambda acc: acc.n + F.least(acc.p, acc.r),
    )
    return done


def token_f1_arrays(a: Column, b: Column) -> Column:
    def scored(a: Column, b: Column) -> Column:
        return let(lambda both: f1(ratio(both, F.size(a)), ratio(both, F.size(b))), multiset_overlap(a, b))

    return let(scored, a, b)


def token_f1(p: Column | str, e: Column | str) -> Column:
    """F1 over words, repeats counted; nothing on either side is 0."""
    return token_f1_arrays(tokens(p), tokens(e))


def token_f1_best(p: Column | str, references: Column | str) -> Column:
    """The best over an array of references."""
    return F.coalesce(F.array_max(F.transform(col(references), lambda e: token_f1(p, e))), F.lit(0.0))


def word_edits(p: Column | str, e: Column | str) -> tuple[Column, Column]:
    """Edits between word sequences, and reference words: each distinct word of the pair becomes one private character, so `levenshtein` counts words."""
    # From U+10000 on, past the surrogates: UTF-32 of the word's number.
    letter = lambda known, w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")
    coded = lambda known, xs: F.array_join(F.transform(xs, lambda w: letter(known, w)), "")
    words = lambda x: F.filter(F.split(collapse(x), " "), lambda w: w != "")
    edits = let(lambda a, b: let(lambda known: F.levenshtein(coded(known, a), coded(known, b)), F.array_distinct(F.concat(a, b))), words(p), words(e))
    return edits, F.size(words(e))


def word_error_rate(p: Column | str, e: Column | str) -> Column:
    """Word edits over reference words; an empty side is 1."""
    edits, n = word_edits(p, e)
    empty = (F.coalesce(collapse(p), F.lit("")) == "") | (F.coalesce(collapse(e), F.lit("")) == "")
    return F.when(empty, 1.0).otherwise(edits / n.cast("double"))


def character_error_rate(p: Column | str, e: Column | str) -> Column:
    p, e = strip(p), strip(e)
    empty = (F.coalesce(p, F.lit("")) == "") | (F.coalesce(e, F.lit("")) == "")
    return F.when(empty, 1.0).otherwise(F.levenshtein(p, e) / F.char_length(e).cast("double"))


def squared_error(p: Column | str, e: Column | str) -> Column:
    """NaN where a side is no number."""
    a, b = (col(x).cast("string").try_cast("double") for x in (p, e))
    return F.coalesce(F.pow(a - b, F.lit(2.0)), F.lit(float("nan")))


def mean_or(x: Column | str, default: float = 0.0) -> Column:
    """Mean of the values that are neither null nor NaN."""
    return F.coalesce(F.avg(F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))), F.lit(float(default)))


def pearson(p: Column | str, e: Column | str, clamp: bool = True) -> Column:
    """Over pairs of finite values; 0 for fewer than two or without variance."""
    a, b = (F.nanvl(col(x).cast("double"), F.lit(None).cast("double")) for x in (p, e))
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    a, b = F.when(finite, a), F.when(finite, b)
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    r = F.when(F.count(F.when(finite, 1)) >= 2, F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)) if clamp else r


# BLEU and chrF, from their papers: counts per row that add up, then one formula for a row or a corpus.


def tokenize_13a(x: Column | str) -> Column:
    """The mteval-v13a rules: entities, punctuation apart unless inside a number, dash after a digit."""
    x = F.coalesce(col(x), F.lit(""))
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        x = F.regexp_replace(x, a, b)
    return F.filter(F.split(x, r"\s+", -1), lambda t: t != "")


def ngrams(items: Column, n: int, glue: str = " ") -> Column:
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, n), glue))).otherwise(F.array().cast("array<string>"))


def bleu_counts(p: Column | str, e: Column | str, order: int = 4) -> Column:
    """(match, total) arrays by order, p_len and r_len."""
    def counted(a: Column, b: Column) -> Column:
        grams = [(ngrams(a, n), ngrams(b, n)) for n in range(1, order + 1)]
        return F.struct(
            F.array(*(multiset_overlap(x, y).cast("long") for x, y in grams)).alias("match"),
            F.array(*(F.size(x).cast("long") for x, _ in grams)).alias("total"),
            F.size(a).cast("long").alias("p_len"),
            F.size(b).cast("long").alias("r_len"),
        )

    return let(counted, tokenize_13a(p), tokenize_13a(e))


def bleu_from(match: list[Column], total: list[Column], p_len: Column, r_len: Column, effective: bool) -> Column:
    """0 to 1, with exponential smoothing of orders without a match; `effective` leaves out orders that the hypothesis is too short for."""
    log_sum, smooth, used = F.lit(0.0), F.lit(1.0), F.lit(0)
    for m, t in zip(match, total, strict=True):
        smooth = F.when((m == 0) & (t > 0), smooth * 2).otherwise(smooth)
        p = F.when(m > 0, F.try_divide(m.cast("double"), t.cast("double"))).when(t > 0, F.try_divide(F.lit(1.0), smooth * t))
        log_sum = log_sum + F.coalesce(F.log(p), F.lit(0.0))
        used = used + F.when(t > 0, 1).otherwise(0)
    n = used if effective else F.lit(len(match))
    brevity = F.when(p_len < r_len, F.exp(1 - F.try_divide(r_len.cast("double"), p_len.cast("double")))).otherwise(1.0)
    whole = F.when(match[0] == 0, 0.0).when((used < len(match)) & F.lit(not effective), 0.0)
    return F.coalesce(whole, brevity * F.exp(F.try_divide(log_sum, n)), F.lit(0.0))


def sentence_bleu(p: Column | str, e: Column | str, order: int = 4) -> Column:
    return let(lambda c: bleu_from([c.match[i] for i in range(order)], [c.total[i] for i in range(order)], c.p_len, c.r_len, True), bleu_counts(p, e, order))


def corpus_bleu(df: DataFrame, p: str, e: str, by: list[str] | None = None, order: int = 4) -> DataFrame:
    """Two-phase: counts a row, sums a group (combined before the shuffle), one formula; column `bleu`."""
    rows = df.select(*(by or []), bleu_counts(p, e, order).alias("c"))
    sums = [F.sum(F.col("c.match")[i]).alias(f"m{i}") for i in range(order)] + [F.sum(F.col("c.total")[i]).alias(f"t{i}") for i in range(order)]
    out = rows.groupBy(*(by or [])).agg(*sums, F.sum("c.p_len").alias("p_len"), F.sum("c.r_len").alias("r_len"))
    score = bleu_from([F.col(f"m{i}") for i in range(order)], [F.col(f"t{i}") for i in range(order)], F.col("p_len"), F.col("r_len"), False)
    return out.select(*(by or []), score.alias("bleu"))


def chrf_counts(p: Column | str, e: Column | str, order: int = 6) -> Column:
    """(match, p_total, r_total) arrays by order, over characters without white space."""
    chars = lambda x: F.regexp_extract_all(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+", ""), F.lit("(?s)."), 0)

    def counted(a: Column, b: Column) -> Column:
        grams = [(ngrams(a, n, ""), ngrams(b, n, "")) for n in range(1, order + 1)]
        return F.struct(
            F.array(*(multiset_overlap(x, y).cast("long") for x, y in grams)).alias("match"),
            F.array(*(F.size(x).cast("long") for x, _ in grams)).alias("p_total"),
            F.array(*(F.size(y).cast("long") for _, y in grams)).alias("r_total"),
        )

    return let(counted, chars(p), chars(e))


def chrf_from(match: list[Column], p_total: list[Column], r_total: list[Column], beta: float = 2.0) -> Column:
    """Mean precision and recall over the orders that both sides have, combined with recall weighted beta times."""
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for m, a, b in zip(match, p_total, r_total, strict=True):
        both = (a > 0) & (b > 0)
        precision = precision + F.when(both, ratio(m, a)).otherwise(0.0)
        recall = recall + F.when(both, ratio(m, b)).otherwise(0.0)
        used = used + F.when(both, 1).otherwise(0)
    p, r = ratio(precision, used), ratio(recall, used)
    return ratio((1 + beta**2) * p * r, beta**2 * p + r)


def sentence_chrf(p: Column | str, e: Column | str, order: int = 6) -> Column:
    return let(lambda c: chrf_from(*([c[k][i] for i in range(order)] for k in ("match", "p_total", "r_total"))), chrf_counts(p, e, order))


def corpus_chrf(df: DataFrame, p: str, e: str, by: list[str] | None = None, order: int = 6) -> DataFrame:
    rows = df.select(*(by or []), chrf_counts(p, e, order).alias("c"))
    sums = [F.sum(F.col(f"c.{k}")[i]).alias(f"{k}{i}") for k in ("match", "p_total", "r_total") for i in range(order)]
    out = rows.groupBy(*(by or [])).agg(*sums)
    return out.select(*(by or []), chrf_from(*([F.col(f"{k}{i}") for i in range(order)] for k in ("match", "p_total", "r_total"))).alias("chrf"))


@dataclass(frozen=True)
class Metric:
    """A row expression of (prediction, expected), the default of its mean, and whether more is better."""

    name: str
    row: Callable[[Column, Column], Column]
    default: float = 0.0
    higher_is_better: bool = True

    def aggregate(self, column: str | None = None) -> Column:
        return mean_or(column or self.name, self.default)


REGISTRY: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("exact_match", exact_match),
        Metric("f1", token_f1),
        Metric("wer", word_error_rate, 1.0, False),
        Metric("cer", character_error_rate, 1.0, False),
        Metric("mse", squared_error, 0.0, False),
        Metric("bleu", sentence_bleu),
        Metric("chrf", sentence_chrf),
    )
}


def register(metric: Metric) -> None:
    REGISTRY[metric.name] = metric


def score(df: DataFrame, names: list[str], prediction: str = "prediction", expected: str = "expected") -> DataFrame:
    return df.withColumns({n: REGISTRY[n].row(F.col(prediction), F.col(expected)) for n in names})


def aggregate(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*(REGISTRY[n].aggregate().alias(n) for n in names))
