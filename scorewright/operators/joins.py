"""Pairings, alignments and overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def both_ways(a: Column, b: Column, a_lang: Column, b_lang: Column) -> Column:
    """The two directions of a pair, to be exploded."""

    def way(x: Column, y: Column, xl: Column, yl: Column) -> Column:
        return F.struct(x.alias("source_text"), y.alias("target_text"), xl.alias("source_language"), yl.alias("target_language"), F.concat_ws("_", xl, yl).alias("direction"), F.concat_ws("_", F.least(a_lang, b_lang), F.greatest(a_lang, b_lang)).alias("language_pair"))

    return F.array(way(a, b, a_lang, b_lang), way(b, a, b_lang, a_lang))


def paired_languages(texts: DataFrame, pairs: list[tuple[str, str]], id_col: str = "id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Texts of the same id in two languages, each pair twice. One join for all pairs, on the id and the pair; other languages stay out of it."""
    wanted = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))

    def side(own: str) -> DataFrame:
        named = F.explode(F.filter(wanted, lambda p: p[own] == F.col(lang))).alias("pair")
        return texts.select(F.col(id_col).alias("id"), F.col(text).alias(f"{own}_text"), named).select("id", f"{own}_text", "pair.a", "pair.b")

    met = side("a").join(side("b"), ["id", "a", "b"])
    return met.select("id", F.explode(both_ways(F.col("a_text"), F.col("b_text"), F.col("a"), F.col("b"))).alias("way")).select("id", "way.*")


def bidirectional(df: DataFrame, a: str, b: str, a_lang: str, b_lang: str) -> DataFrame:
    """Rows with both sides filled, in both directions."""
    full = df.filter((F.trim(F.coalesce(F.col(a), F.lit(""))) != "") & (F.trim(F.coalesce(F.col(b), F.lit(""))) != ""))
    rest = [c for c in df.columns if c not in (a, b)]
    return full.select(*rest, F.explode(both_ways(F.col(a), F.col(b), F.lit(a_lang), F.lit(b_lang))).alias("way")).select(*rest, "way.*")


def align_fields(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on the keys with a presence flag a side: status matched, missed or spurious. Flags, not nulls, tell absence."""
    p, e = predicted.withColumn("has_p", F.lit(True)), expected.withColumn("has_e", F.lit(True))
    status = F.when(F.col("has_p") & F.col("has_e"), "matched").when(F.col("has_e"), "missed").otherwise("spurious")
    return p.join(e, keys, "full_outer").withColumn("status", status).drop("has_p", "has_e")


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Numbers equal keys in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def align_unordered(predicted: DataFrame, expected: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    """One-to-one matches of equal keys, the first left over taken first: the n-th occurrence meets the n-th.

    Adds `place`, where a predicted item stands after alignment: matched ones in expected order, the rest after them by key.
    """
    p, e = (occurrence(x, [*group, key], [order]) for x in (predicted, expected))
    e = e.select(*group, key, "occurrence", F.col(order).alias("e_order"))
    met = p.join(e, [*group, key, "occurrence"], "left")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("e_order").asc_nulls_last(), key, order)) - 1
    return met.withColumn("place", place)


def not_done(samples: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return samples.join(done.select(key), key, "left_anti")


def by_record(results: DataFrame, rows: DataFrame, record: str = "record_id", sample: str = "sample_id", index: str = "row_idx") -> DataFrame:
    """Rows that results name by record id, or else by the number at the end of their sample id; each row once, in order."""
    number = F.regexp_extract(F.col(sample), r"(\d+)$", 1).try_cast("long")
    named = results.filter(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("k")).distinct()
    placed = results.filter(F.col(record).isNull()).select(number.alias("k")).filter("k is not null").distinct()
    by_id = rows.join(named, rows[record].cast("string") == F.col("k"), "left_semi")
    by_place = rows.join(placed, rows[index] == F.col("k"), "left_semi")
    return by_id.unionByName(by_place).dropDuplicates([index]).orderBy(index)


def with_listing(df: DataFrame, files: DataFrame, stem: str = "stem", priority: list[str] | None = None) -> DataFrame:
    """The file of each stem (stem, ext, path), the earliest extension of the list first; rows without one are dropped."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("ext")) if priority else F.lit(1)
    best = files.filter(order > 0).groupBy(stem).agg(F.min_by("path", F.struct(order.alias("o"), F.col("path").alias("p"))).alias("path"))
    return df.join(best, stem)


def canonical_key(key: Column) -> Column:
    """Dashes after the first dot are underscores."""
    head, tail = F.substring_index(key, ".", 1), F.substring(key, F.locate(".", key) + 1, F.char_length(key))
    return F.when(F.contains(key, F.lit(".")), F.concat(head, F.lit("."), F.replace(tail, F.lit("-"), F.lit("_")))).otherwise(key)


def attach(tasks: DataFrame, found: DataFrame, key: str = "task") -> DataFrame:
    """Left join by the exact key, else by the canonical one; the columns of found, null where neither meets."""
    values = [c for c in found.columns if c != key]
    exact = found.select(F.col(key), F.struct(*values).alias("exact"))
    loose = found.groupBy(canonical_key(F.col(key)).alias("ckey")).agg(F.min_by(F.struct(*values), key).alias("loose"))
    met = tasks.join(exact, key, "left").withColumn("ckey", canonical_key(F.col(key))).join(loose, "ckey", "left")
    return met.withColumn("found", F.coalesce("exact", "loose")).select(*tasks.columns, *(F.col("found")[v].alias(v) for v in values))


def overlay(*layers: DataFrame, key: str, canonical: bool = True) -> DataFrame:
    """Rows of all layers, a later layer winning a key; keys that agree canonically are one, in the spelling of the last."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn("_layer", F.lit(i)) for i, d in enumerate(layers)))
    group = canonical_key(F.col(key)) if canonical else F.col(key)
    values = [c for c in stacked.columns if c != "_layer"]
    best = stacked.groupBy(group.alias("_key")).agg(F.max_by(F.struct(*values), F.struct("_layer", key)).alias("row"))
    return best.select("row.*")


def with_skips(metrics: DataFrame, skipped: DataFrame, key: str = "subtask") -> DataFrame:
    """Full outer join; a skipped subtask stays skipped though it has metrics."""
    met = metrics.join(skipped.select(key, F.col("reason").alias("skip_reason"), F.lit(True).alias("is_skipped")), key, "full_outer")
    return met.withColumn("is_skipped", F.coalesce("is_skipped", F.lit(False)))


def bridge(df: DataFrame, *columns: str, name: str = "language") -> DataFrame:
    """One row for each different value of the columns."""
    return df.withColumn(name, F.explode(F.array_distinct(F.array(*columns))))
