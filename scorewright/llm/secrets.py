r"""Secret scans by character Markov models, with DataFrame functions only.

Two first-order models over characters, one of random strings and one of ordinary words and identifiers, are counted from labelled
samples. A run of `[A-Za-z0-9+/_=-]` of `least` characters or more is a secret if the log-likelihood ratio of the models is
`per_step` or more for each step, over all its steps. It is added as kind "random" unless it overlaps a base span.

So that a random key behind a long ordinary path is not diluted, the pieces of a run between `/`, `_`, `-` and `=` that are `least` characters
or longer are judged by themselves too; a run is a secret if it or one of them is.

Places of matches: a text is split at the matches of a pattern, and the lengths of pieces and matches are summed.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; spans are of whole matches;
characters that the models don't know can't occur in a candidate; texts of any length and any number of matches take time in proportion;
repeated rows give their spans each; spans of equal start are in order of kind; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import let, running, slices

#: Base kinds in order. Each pattern takes a maximal run, so its least length is the same as dropping shorter matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WORDS = """get set user name list item value count index table query order account customer total price date time start end first last
open close read write file path input output buffer stream string number array object class method function return parse
format build create update delete remove insert select filter search result error message request response header body server client
session connect timeout retry config option default enable disable handler listener event queue worker thread process
memory cache store record field column schema version module package import export test check valid status state""".split()
SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def generated_samples(spark: SparkSession, rows: int = 2000) -> DataFrame:
    """(text, is_random): random strings of four alphabets, identifiers in four styles, and runs. The same at every call."""
    n = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    upper = F.upper(F.translate(base64, "+/", "xy"))
    random = n.select(F.explode(F.array(digest, base64, upper, F.lower(upper))).alias("text"), F.lit(True).alias("is_random"))
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    a, b, c = word(1), word(2), word(3)
    styles = F.array(F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b), F.concat(F.initcap(a), F.initcap(b)))
    ordinary = n.select(F.explode(styles).alias("text"), F.lit(False).alias("is_random"))
    # Rulers, fillers and counting are ordinary too.
    runs = F.array(*(F.repeat(F.lit(c), F.lit(40)) for c in CHARS), *(F.repeat(F.lit(c), F.lit(10)) for c in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "=-", "-_")))
    return random.unionByName(ordinary).unionByName(spark.range(5).select(F.explode(runs).alias("text"), F.lit(False).alias("is_random")))


def ordinary_words(docs: DataFrame, labels: DataFrame, sample_rows: int = 400) -> DataFrame:
    """(text, is_random false): words of documents that are labelled as of good quality; at most sample_rows documents, by hash of their ids."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good_id")).distinct().orderBy(F.xxhash64("good_id"), "good_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left_semi")
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{4,}\b"), 0)).alias("text"), F.lit(False).alias("is_random"))


def steps(text: Column) -> Column:
    """Numbers of pairs of neighbouring characters; one for each but the last."""
    chars = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), lambda c: F.ascii(c))
    return F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: a * 128 + b)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """samples (text, is_random): log-likelihood ratios of the pairs, at number a * 128 + b; at most 2 * 128 * 128 counts reach the driver."""
    clean = samples.filter(F.col("text").rlike("^[A-Za-z0-9+/_=-]+$"))
    pairs = clean.select("is_random", F.explode(steps(F.col("text"))).alias("pair"))
    counts = {(r.is_random, r.pair): r["count"] for r in pairs.groupBy("is_random", "pair").count().collect()}
    codes, table = [ord(c) for c in CHARS], [0.0] * (128 * 128)
    for a in codes:
        total = {k: sum(counts.get((k, a * 128 + b), 0) for b in codes) + smoothing * len(codes) for k in (True, False)}
        for b in codes:
            p = {k: (counts.get((k, a * 128 + b), 0) + smoothing) / total[k] for k in total}
            table[a * 128 + b] = math.log(p[True] / p[False])
    return table


def ratio(text: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of the text's steps."""
    weights = F.from_json(F.lit(str(table)), "array<double>")
    found = F.transform(steps(text), lambda pair: F.element_at(weights, pair + 1))
    return F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(found), F.lit(1))


def places(text: Column, matches: Column, pattern: str) -> Column:
    """Start and end of each of the matches, which are all those of the pattern in order."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("bigint"))
    sizes = F.transform(matches, lambda m: F.char_length(m).cast("bigint"))
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), sizes, lambda gap, n: gap + n)
    found = F.zip_with(running(steps), sizes, lambda end, n: F.struct((end - n).alias("start"), end.alias("end")))
    return F.when(F.size(matches) > 0, found)


def _spans(found: Column, keep: Column | None, kind: int) -> Column:
    span = lambda x: F.struct(x.start.alias("start"), F.lit(kind).alias("kind_no"), x.end.alias("end"), F.lit(KINDS[kind]).alias("kind"))
    if keep is not None:
        found = F.filter(F.zip_with(found, keep, lambda s, k: F.when(k, s)), lambda s: s.isNotNull())
    return F.coalesce(F.transform(found, span), F.array().cast(SPANS))


def is_random(run: Column, table: list[float], least: int, per_step: float) -> Column:
    parts = F.filter(F.split(run, "[/_=-]+", -1), lambda p: (F.char_length(p) >= least) & (F.char_length(p) < F.char_length(run)))
    return (ratio(run, table) >= per_step) | F.exists(parts, lambda p: ratio(p, table) >= per_step)


def alone(spans: Column, base: Column) -> Column:
    """The spans that overlap none of base, which is in order of start; slices of base that lie elsewhere are passed over whole."""
    ends = lambda xs: F.struct(F.element_at(xs, 1).start.alias("low"), F.array_max(F.transform(xs, lambda b: b.end)).alias("high"), xs.alias("spans"))
    meets = lambda a, low, high: (low < a.end) & (a.start < high)
    clear = lambda parts, spans: F.filter(spans, lambda m: ~F.exists(parts, lambda p: meets(m, p.low, p.high) & F.exists(p.spans, lambda b: meets(m, b.start, b.end))))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(clear, F.transform(slices(base), ends), spans)).otherwise(spans)


def find_secrets(docs: DataFrame, table: list[float], least: int = 20, per_step: float = 0.8) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind_no, end, kind) in order of start, then kind."""
    token = rf"[A-Za-z0-9+/_=-]{{{least},}}"
    t, c = F.col("text"), F.col
    every = lambda pattern, group=0: F.regexp_extract_all(t, F.lit(pattern), group)
    rows = docs.select("doc_id", F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    hits = rows.select("doc_id", "text", every(ASSIGN).alias("m0"), every(ACCESS).alias("m1"), every(HEX).alias("m2"), every(token).alias("m3"))
    hits = hits.withColumn("v0", F.when(F.size("m0") > 0, every(ASSIGN, 1)))
    hits = hits.withColumn("r3", F.transform("m3", lambda m: is_random(m, table, least, per_step)))
    found = hits.select("doc_id", *(places(t, c(f"m{i}"), p).alias(f"p{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX))), F.when(F.exists("r3", lambda r: r), places(t, c("m3"), token)).alias("p3"), "v0", "r3")
    spans = found.select("doc_id", F.array_sort(F.concat(_spans(c("p0"), F.transform("v0", lambda v: F.char_length(v) >= 6), 0), _spans(c("p1"), None, 1), _spans(c("p2"), None, 2))).alias("base"), _spans(c("p3"), c("r3"), 3).alias("more"))
    return spans.select("doc_id", "base", F.array_sort(F.concat("base", alone(c("more"), c("base")))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
