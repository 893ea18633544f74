r"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule rejects a text by features of it. On a sample, the clock is read before and after each rule for each text, so a rule's
cost is its own time and not that of a job; its selectivity is the share that it rejects. Rules are then ordered by rejection per cost and
nested: a later rule, with the features that it needs, is not evaluated for a text that an earlier one rejects. The order
changes cost alone: a text is kept if no rule rejects it. Features that the caller wants returned are computed for every text, as
they have to be, and the rules read them; judge() without them skips.

Defined results: null text has no words; a rule that gives null does not reject; repeated rows are kept; very long texts are read whole;
an empty table gives none and an order by name; rules of equal rejection per cost go by name; other columns are kept by judge(),
whatever their names, and ignored by features().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import let
from ._store import forget, unused, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Callable[[str], Column]], Column]  # of a function that gives a feature by name


@dataclass(frozen=True)
class Measured:
    name: str
    cost: float
    rejected: float


def _union(starts: Column, size: int) -> Column:
    """Words under windows that begin at the sorted starts."""
    inner = F.aggregate(starts, F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc.n + F.least(F.lit(size), i - acc.last)).alias("n")))
    return F.coalesce(inner.n, F.lit(0)).cast("long")


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")


def _windows(words: Column, size: int) -> Column:
    n = F.size(words)
    return F.transform(F.when(n > size, F.sequence(F.lit(1), n - (size - 1))), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(size))))


def _ordered(windows: Column) -> Column:
    """Windows with their places in order of hash; null if all differ, which one hash set tells."""
    return F.when(F.size(windows) > F.size(F.array_distinct(windows)), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeated(o: Column) -> Column:
    """Sorted places of the windows that occur twice or more."""
    twice = F.transform(o, lambda x, k: F.when((x.h == F.get(o, k - 1).h) | (x.h == F.get(o, k + 1).h), x.i))
    return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))


def feature(name: str, t: Column, size: int = 3) -> Column:
    """A feature as one expression of the text, to be evaluated where it is needed and not before."""
    match name:
        case "n_words":
            out = F.regexp_count(t, F.lit(WORD))
        case "word_chars":
            out = F.char_length(F.translate(t, SPACE, ""))
        case "n_symbols":
            out = F.regexp_count(t, F.lit(SYMBOL))
        case "n_lines":
            out = F.size(_lines(t))
        case "n_dup_lines":
            out = let(lambda x: F.size(x) - F.size(F.array_distinct(x)), _lines(t))
        case "n_repeat_words":
            out = let(lambda w: let(lambda h: let(lambda o: _union(let(_repeated, o), size), _ordered(h)), _windows(w, size)), _words(t))
        case _:
            raise KeyError(name)
    return out.cast("long")


def features(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and text with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long), for every text.

    n_repeat_words: words in windows of `size` words that the text has twice or more, compared by 64-bit hash. Each step is a
    projection of its own, so no array is made twice.
    """
    t = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"words": _words(t), "lines": _lines(t)})
    rows = rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), feature("word_chars", t).alias("word_chars"), feature("n_symbols", t).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("words"), size).alias("windows"),
    )
    rows = rows.withColumn("ordered", _ordered(F.col("windows")))
    rows = rows.withColumn("starts", _repeated(F.col("ordered")))
    return rows.withColumn("n_repeat_words", _union(F.col("starts"), size)).drop("windows", "ordered", "starts")


def default_rules() -> list[Rule]:
    """Over the features."""
    return [
        Rule("few words", lambda f: f("n_words") < 50),
        Rule("repeated windows", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
        Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
        Rule("repeated lines", lambda f: 10 * f("n_dup_lines") > 5 * f("n_lines")),
        Rule("word length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 15 * f("n_words"))),
    ]


def measure(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000, seed: int = 1) -> list[Measured]:
    """Cost (nanoseconds a text) and selectivity of each rule, over about sample_rows rows drawn at random from all of docs.

    The sample is written once, with a copy of the text for each rule, so that no rule finds work that another has done. It is gone
    through twice; the second time counts, when code is compiled.
    """
    total = docs.count()
    if not total or not rules:
        return [Measured(r.name, 1.0, 0.0) for r in rules]
    drawn = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).sample(False, min(1.0, sample_rows / total), seed).limit(2 * sample_rows)
    sample = written(drawn.select(*(F.col("text").alias(f"text_{i}") for i in range(len(rules)))), "sample")
    clock = F.call_function("java_method", F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    timed = []
    for i, rule in enumerate(rules):
        hit = rule.rejects(lambda name, i=i: feature(name, F.col(f"text_{i}")))
        timed += [clock.alias(f"t{i}"), F.coalesce(hit, F.lit(False)).alias(f"r{i}")]
    passes = sample.select(F.struct(*timed, clock.alias(f"t{len(rules)}")).alias("x"))
    sums = [F.avg(F.col(f"x.t{i + 1}") - F.col(f"x.t{i}")).alias(f"c{i}") for i in range(len(rules))] + [F.avg(F.col(f"x.r{i}").cast("double")).alias(f"s{i}") for i in range(len(rules))]
    for _ in range(2):
        row = passes.agg(*sums).first()
    forget(sample)
    return [Measured(r.name, max(row[f"c{i}"] or 0.0, 1.0), row[f"s{i}"] or 0.0) for i, r in enumerate(rules)]


def ordered(rules: list[Rule], measured: list[Measured]) -> list[Rule]:
    by = {m.name: m for m in measured}
    return sorted(rules, key=lambda r: (-by[r.name].rejected / by[r.name].cost, r.name))


def cascade(rules: list[Rule], give: Callable[[str], Column]) -> Column:
    """The name of the first rule in this order that rejects, or null; features that no earlier rule needed are evaluated only where a rule is reached."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(give), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000, with_features: bool = False) -> DataFrame:
    """docs with rejected_by, the first rule of the measured order that rejects (null: kept). with_features: features() of docs instead of docs' columns."""
    rules = default_rules() if rules is None else rules
    order = ordered(rules, measure(docs, rules, sample_rows))
    if with_features:
        return features(docs).withColumn("rejected_by", cascade(order, F.col)).drop("text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(unused(docs, "rejected_by"), cascade(order, lambda name: feature(name, text)))
