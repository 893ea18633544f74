r"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys (md5 of doc_id). A source's order is that of its keys (ties: size, then the row's number in the
written table), and a source is taken whole as often as its target allows; the rest is cut at its exact budget in that order,
in the middle of a document if need be.

The cut is found from sums alone. A key's first digits are its range; prefix sums over the ranges tell in which one a source's
budget ends. Its rows are summed by key, size and input partition, which tells the class of rows that the budget ends in, and
only that class, never larger than an input partition, is numbered. Then every row knows by comparison with its source's cut row
whether it is taken, so neither texts nor rows are sorted or moved, and null or repeated ids are no hot range.

Targets: the budget is shared by weight; a source stops at `most_epochs` times its size and its excess is shared again by
weight, until none is above. That is min(most, level * weight) for one level, found by sorting sources by size over weight.

Defined results: null text has size 0; rows without a doc_id are taken like others; a null source is a source, last, and not the
empty one; repeated rows are rows of their own; very long texts are cut like others; an empty table gives none; a source of size 0
has target 0 and gives no row; other columns are kept by mixed() and ignored by mix(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import small_enough, unused, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the table of sources up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float) -> DataFrame:
    """sizes (source_key, source_size): with target. A row for each source, so its one-task window is over source names only."""
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(Window.orderBy("source_key")) - 1, F.lit(len(weights))) + 1).cast("int")))
    most = ranked.withColumn("most", most_epochs * F.col("source_size")).withColumn("bar", F.col("most") / F.col("weight"))
    order = Window.orderBy("bar", "source_key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # What all sources take at a level is the least of the lines that these levels solve, so the level that meets the budget is the highest.
    levels = most.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    return levels.select("source_key", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def placed(docs: DataFrame) -> Column:
    """What the mix needs of a row: source_key, size, key and the number of the row."""
    source = F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")), F.lit("w"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.struct(source.alias("source_key"), words_in(F.col("text").cast("string")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"))


def cuts(rows: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float, digits: int) -> DataFrame:
    """rows (source_key, size, key, row): (source_key, source_size, target, copies, cut_key, cut_size, cut_row, cut_words), a row a source.

    Rows of the source's order before the cut row are taken once more than copies, of the cut row cut_words. Without a cut, the last four are null.
    """
    rows = rows.withColumns({"range": F.substring("key", 1, digits), "part": F.shiftright("row", 33)})
    ranges = written(rows.groupBy("source_key", "range").agg(F.sum("size").alias("n")), "ranges")
    sources = source_targets(ranges.groupBy("source_key").agg(F.sum("n").alias("source_size")), weights, share, most_epochs)
    copies = F.coalesce(F.floor(F.try_divide(F.floor("target"), F.col("source_size"))), F.lit(0)).cast("long")
    sources = sources.withColumn("copies", copies).withColumn("left", F.floor("target").cast("long") - F.col("copies") * F.col("source_size"))
    sources = written(sources, "sources")

    def hit(sums: DataFrame, order: list[str]) -> DataFrame:
        """Of sums (source_key, ..., n, left), the one of each source that its budget ends in; left is what is still to be taken of it."""
        ahead = F.sum("n").over(Window.partitionBy("source_key").orderBy(*order)) - F.col("n")
        return sums.withColumn("left", F.col("left") - ahead).filter("left >= 0 and left < n")

    inside = hit(ranges.join(sources.select("source_key", "left"), "source_key"), ["range"]).select("source_key", "range", "left")
    near = rows.join(inside, ["source_key", "range"]).groupBy("source_key", "key", "size", "part").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
    class_ = hit(near, ["key", "size", "part"]).select("source_key", "key", "size", "part", "left")
    number = F.row_number().over(Window.partitionBy("source_key").orderBy("row"))
    cut = rows.join(class_, ["source_key", "key", "size", "part"]).withColumn("number", number).filter(F.col("number") == F.floor(F.col("left") / F.col("size")) + 1)
    cut = cut.select("source_key", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.col("row").alias("cut_row"), (F.col("left") % F.col("size")).alias("cut_words"))
    return written(sources.drop("left").join(cut, "source_key", "left"), "cuts")


def _planned(rows: DataFrame, at: str, how: dict) -> tuple[DataFrame, Column, Column]:
    """rows with their source's cut in the struct `plan`-to-be named at + "_cut"; how often a row is taken whole, and how many words of it are taken beside."""
    found = cuts(rows.select(f"{at}.*"), **how)
    plan = found.select(F.col("source_key").alias(f"{at}_source"), F.struct(*(c for c in found.columns if c != "source_key")).alias(f"{at}_cut"))
    if small_enough(plan, BROADCAST_ROWS):
        plan = F.broadcast(plan)
    met = rows.join(plan, F.col(f"{at}.source_key") == F.col(f"{at}_source")).drop(f"{at}_source")
    own, cut = F.col(at), F.col(f"{at}_cut")
    here, there = F.struct(own.key, own["size"], own.row), F.struct(cut.cut_key, cut.cut_size, cut.cut_row)
    whole = cut.copies + F.when(cut.cut_key.isNotNull() & (here < there), 1).otherwise(0)
    return met, whole.cast("long"), F.when(own.row == cut.cut_row, cut.cut_words).otherwise(0).cast("long")


def _how(weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2, digits: int = 3) -> dict:
    return {"weights": weights, "share": share, "most_epochs": most_epochs, "digits": digits}


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, cut): copies whole, then `cut` words of one more.

    weights: of the sources in order of their names, repeating; share: of all words; most_epochs: how often a source may be taken;
    digits: hex digits of the key that make a range; a third of all rows in a source are 16^digits ranges of its own.
    """
    rows = written(docs.select("doc_id", "source", placed(docs).alias("at")), "sizes")
    met, whole, part = _planned(rows, "at", _how(**how))
    own, cut = F.col("at"), F.col("at_cut")
    met = met.withColumns({"whole": whole, "part": part})
    words = F.when(F.col("whole") > cut.copies, own["size"]).otherwise(F.col("part"))
    return met.select("doc_id", "source", own["size"].alias("size"), cut.source_size.alias("source_size"), cut.target.alias("target"), (cut.copies * own["size"] + words).alias("taken"), cut.copies.alias("copies"), words.alias("cut"))


def first_words(text: Column, n: Column) -> Column:
    """The beginning of the text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), 1, n.cast("int")), "")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each document as often as it is taken, the one at the cut of its source by its first words."""
    at = unused(docs, "mix_at")
    rows = written(docs.withColumn(at, placed(docs)), "mix")
    met, whole, part = _planned(rows, at, _how(**how))
    copy = unused(docs, "mix_copy")
    n = whole + F.when(part > 0, 1).otherwise(0)
    met = met.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n))))
    out = met.withColumn("text", F.when(F.col(copy) > whole, first_words(F.col("text").cast("string"), part)).otherwise(F.col("text"))).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
