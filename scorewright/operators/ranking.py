"""Quartiles, buckets, ranks, top and bottom rows, latest versions.

A rank over all rows is by nature one order of everything; `ranked` finds it by range partitions and their starts, so no task
sorts the whole table. A rank inside groups is a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mapping import numbered

#: Candidates for the primary metric of a run, in order, and columns that are never one.
CANDIDATES = ("document_extraction_score", "overall_extraction_quality_score", "extraction_quality_score", "field_f1_partial", "accuracy", "exact_match", "bleu", "chrf", "comet", "score")
NOT_METRICS = ("sample_id", "valid", "error", "error_type", "schema_fingerprint")
BUCKETS = ("q1_lowest", "q2_lower_mid", "q3_upper_mid", "q4_highest")


def run_metric(df: DataFrame) -> str | None:
    """The first candidate with a finite value, else the numeric column with most of them (ties by name). One pass over the table."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") and f.name not in NOT_METRICS]
    if not numeric:
        return None
    finite = lambda c: F.count_if(F.abs(F.col(c).cast("double")) < float("inf"))
    counts = df.agg(*(finite(c).alias(c) for c in numeric)).first().asDict()
    named = [c for c in CANDIDATES if counts.get(c)]
    rest = sorted((c for c in numeric if counts[c]), key=lambda c: (-counts[c], c))
    return (named or rest or [None])[0]


def quantiles(df: DataFrame, value: str, at: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(by, q: array, min, max, n): exact quantiles, linear between neighbours, of the values that are neither null nor NaN.

    Values are numbered by range partitions, and only the two neighbours of each quantile are looked up, so no task holds a group's values.
    """
    by = by or []
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, v.alias("_v"))
    ends = [F.min("_v").alias("min"), F.max("_v").alias("max"), F.count("_v").alias("n")]
    placed = numbered(rows.filter("_v is not null"), [*by, "_v"], "_at")
    groups = rows.groupBy(*by).agg(*ends)
    starts = placed.groupBy(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by))).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    place = [F.col("_start") + (F.col("_n") - 1) * F.lit(float(q)) for q in at]
    wanted = F.array(*(F.struct(F.lit(i).alias("k"), F.floor(x).alias("low"), F.ceil(x).alias("high"), (x - F.floor(x)).alias("part")) for i, x in enumerate(place)))
    asked = starts.select(*(f"_b{i}" for i in range(len(by))), F.explode(wanted).alias("w")).select("*", F.explode(F.array(F.struct(F.col("w.low").alias("_at"), (1 - F.col("w.part")).alias("share")), F.struct(F.col("w.high").alias("_at"), F.col("w.part").alias("share")))).alias("x"))
    met = asked.join(placed.select("_at", "_v"), F.col("x._at") == F.col("_at"))
    each = met.groupBy(*(f"_b{i}" for i in range(len(by))), F.col("w.k").alias("k")).agg(F.sum(F.col("x.share") * F.col("_v")).alias("q"))
    found = each.groupBy(*(f"_b{i}" for i in range(len(by)))).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s.q).alias("q"))  # as many as are asked for
    if not by:
        return groups.join(F.broadcast(found), F.lit(True), "left").select("q", "min", "max", "n")  # a row each
    same = reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)))
    return groups.join(found, same, "left").select(*by, "q", "min", "max", "n")


def quartiles(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact quartiles, linear between neighbours, with the ends and the count."""
    return quantiles(df, value, (0.25, 0.5, 0.75), by).select(*(by or []), *(F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q1", "median", "q3"))), "min", "max", "n")


def bucket(value: Column, q1: Column, median: Column, q3: Column) -> Column:
    return F.when(value <= q1, BUCKETS[0]).when(value <= median, BUCKETS[1]).when(value <= q3, BUCKETS[2]).otherwise(BUCKETS[3])


def with_buckets(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Rows with a finite value and their bucket; the quartiles are one row a group."""
    q = quartiles(df, value, by).select(*(by or []), "q1", "median", "q3")
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    met = rows.join(q, by) if by else rows.join(F.broadcast(q))  # one row
    return met.withColumn("bucket", bucket(F.col(value).cast("double"), F.col("q1"), F.col("median"), F.col("q3"))).drop("q1", "median", "q3")


def extremes(df: DataFrame, value: str, ident: str, k: int = 10) -> DataFrame:
    """The k lowest and k highest rows with `side` and `place`; ties by id. Top-k of each task is all that is moved."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_id", F.col(ident).cast("string"))
    low, high = (rows.orderBy(order, F.col("_id")).limit(k) for order in (F.col(value).asc(), F.col(value).desc()))
    place = lambda order: F.row_number().over(Window.orderBy(order, "_id"))
    return low.withColumns({"side": F.lit("lowest"), "place": place(F.col(value).asc())}).unionByName(high.withColumns({"side": F.lit("highest"), "place": place(F.col(value).desc())})).drop("_id")


def ranked(df: DataFrame, value: str, ident: str) -> DataFrame:
    """rank_asc, rank_desc (both from 1, each with ties by id) and percentile (rank - 1) / (n - 1), 1 for a single row."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_id", F.col(ident).cast("string"))
    up = numbered(rows, [F.col(value).asc(), F.col("_id").asc()], "_up")
    # Descending with ties by ascending id: from the other end, but groups of equal values keep their inner order. Ends of groups
    # are an aggregate that is joined back, so the rows of a frequent value stay in many tasks.
    ends = up.groupBy(F.col(value).alias("_value")).agg(F.min("_up").alias("_first"), F.max("_up").alias("_last"))
    n = rows.agg(F.count("*").alias("_n"))
    out = up.join(F.broadcast(n)).join(ends, F.col(value) == F.col("_value")).drop("_value")
    down = F.col("_n") - 1 - F.col("_last") + (F.col("_up") - F.col("_first"))
    percentile = F.when(F.col("_n") == 1, 1.0).otherwise(F.try_divide(F.col("_up").cast("double"), (F.col("_n") - 1).cast("double")))
    return out.withColumns({"rank_asc": F.col("_up") + 1, "rank_desc": down + 1, "percentile": percentile}).drop("_id", "_up", "_first", "_last", "_n")


def ranked_in(df: DataFrame, value: str, ident: str, by: list[str]) -> DataFrame:
    asc, desc = Window.partitionBy(*by).orderBy(F.col(value).asc(), F.col(ident)), Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(ident))
    n = F.count("*").over(Window.partitionBy(*by))
    up = F.row_number().over(asc)
    return df.withColumns({"rank_asc": up, "rank_desc": F.row_number().over(desc), "percentile": F.when(n == 1, 1.0).otherwise(F.try_divide((up - 1).cast("double"), (n - 1).cast("double")))})


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest order for each key: an aggregate, combined before its shuffle, so a key of many versions is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*").select(*df.columns)


def equal_split(df: DataFrame, value: str, ident: str) -> DataFrame:
    """Four parts at n // 4, n // 2 and 3n // 4 rows in order, numbered from 1."""
    rows = numbered(df, [F.col(value).asc(), F.col(ident).asc()], "_at")
    n = df.agg(F.count("*").alias("_n"))
    edge = lambda k: F.floor(F.col("_n") * k / F.lit(4))
    part = F.when(F.col("_at") < edge(1), 1).when(F.col("_at") < edge(2), 2).when(F.col("_at") < edge(3), 3).otherwise(4)
    return rows.join(F.broadcast(n)).withColumn("part", part).drop("_at", "_n")


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("row")).select(key, "row.*").select(*df.columns)
