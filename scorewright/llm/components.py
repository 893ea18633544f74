"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is an aggregate (combined before its shuffle) and a join on the same key, so a node with very many links
is summed in parts; the few nodes that hold a large share of all links are joined by broadcast, so their links stay where they are and no
step gathers a node's links in one task. Labels never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import forget, written

#: A key that holds more than one row in so many is joined by broadcast: there are fewer than that many such keys.
HOT = 1000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_lowest(links: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """links (c, n) with the m of their c. low (c, m, size), size being the links of c, at most `total` in all."""
    large = F.col("size") * HOT > total
    marked = links.join(F.broadcast(low.filter(large).select("c", F.col("m").alias("hot_m"))), "c", "left")
    rest = marked.filter("hot_m is null").drop("hot_m").join(low.filter(~large).drop("size"), "c")
    return marked.filter("hot_m is not null").select("c", "n", F.col("hot_m").alias("m")).unionByName(rest)


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """links (u, v): a row (node, root) for each node, root being the smallest node that it reaches. Loops are ignored."""
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    state = _state(now)
    for _ in range(most_rounds):
        # Large star: what is above a node is linked to the smallest node beside it.
        both = now.select(F.col("u").alias("c"), F.col("v").alias("n")).unionByName(now.select(F.col("v").alias("c"), F.col("u").alias("n")))
        low = both.groupBy("c").agg(F.least(F.min("n"), F.first("c")).alias("m"), F.count("*").alias("size"))
        large = _with_lowest(now.select(F.col("v").alias("c"), F.col("u").alias("n")), low, 2 * state[0]).select(F.col("n").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "links")
        # Small star: what is below a node, and the node, are linked to the smallest of them.
        below = large.select(F.col("u").alias("c"), F.col("v").alias("n"))
        low = below.groupBy("c").agg(F.min("n").alias("m"), F.count("*").alias("size"))
        small = _with_lowest(below, low, state[0]).select(F.col("n").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        following = written(small.filter("u <> v").distinct(), "links")
        forget(large)
        forget(now)
        before, state, now = state, _state(following), following
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
