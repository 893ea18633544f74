r"""Chat formatting of reply trees, with DataFrame functions only.

Messages name their parent. Iterative self-joins double the known ancestor of every message each round, so a tree of depth d takes
log2(d) rounds of two-key joins, not d; they sum scores from the root on the way. The leaves of a tree are ranked by
the score of their path, and the paths of the chosen leaves are walked down the same ancestor tables. Only ids and scores move
in these rounds; texts are joined at the end.

A turn is `### role: text</turn>` and a line feed. Inside roles and texts, a backslash is written `\\`, the first
`#` of `###` is `\h`, and the `<` of `</turn>` is `\l` (in roles also `\c` for a colon and `\n` for a line feed), so no
control string survives in them and reading back is exact. The loss mask lists the spans of assistant texts.

Defined results: null texts and roles are empty; a message whose parent is absent is a root; a null conversation is one of its own; messages of equal turn are ordered by
role, then text; a message without an id is a root and a leaf of its own; of messages that share tree and id, the first by parent, role, text and
score stays; a table without rows gives none; a cycle of parents has no root and raises; other columns are ignored, whatever their names. A
conversation is one value, and formatting and reading it take time in proportion to its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrays import running, texts_at
from ._store import written

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(text, "#(?=##)", r"\\h"), "<(?=/turn>)", r"\\l")


def unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for mark, what in (("h", "#"), ("l", "<"), ("c", ":"), ("n", "\n")):
            part = F.replace(part, F.lit("\\" + mark), F.lit(what))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def _doubled(nodes: DataFrame, most_rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, id, up): the ancestor 1, 2, 4, ... steps up; and (tree, id, depth, total) of all nodes, total from the root on.

    A tree leaves the rounds when all its nodes have met the root, so one deep tree does not carry the others along.
    """
    now = nodes.select("tree", "id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total"))
    tables, met = [], []
    for _ in range(most_rounds):
        now = written(now, "reach")
        open_trees = now.groupBy(F.col("tree").alias("open_tree")).agg(F.bool_or(F.col("up").isNotNull()).alias("open"))
        marked = written(now.join(open_trees, F.col("tree").eqNullSafe(F.col("open_tree"))).select("tree", "id", "up", "depth", "total", "open"), "reach")
        met.append(marked.filter("not open").select("tree", "id", "depth", "total"))
        live = marked.filter("open").drop("open")
        if live.isEmpty():
            return tables, reduce(DataFrame.unionByName, met)
        tables.append(live)
        above = live.select("tree", F.col("id").alias("up"), F.col("up").alias("next_up"), F.col("depth").alias("more"), F.col("total").alias("sum"))
        # A null never joins, so nodes that have met their root keep what they have.
        now = live.join(above, ["tree", "up"], "left").select("tree", "id", F.col("next_up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"))
    raise ValueError("a message is its own ancestor")


def choose_paths(nodes: DataFrame, branches: int = 1, most_rounds: int = 40) -> DataFrame:
    """nodes (tree, id, parent, score) -> (tree, branch, depth, id): the nodes of the best `branches` paths of each tree, from 1, ties to the smaller leaf."""
    ids = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    nodes = nodes.join(ids, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    nodes = written(nodes, "nodes")
    tables, reach = _doubled(nodes, most_rounds)
    inner = nodes.filter("up is not null").select("tree", F.col("up").alias("id")).distinct()
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "id")
    paths = reach.join(inner, ["tree", "id"], "left_anti").withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= branches)
    paths = paths.select("tree", "branch", "depth", "id")
    for k in reversed(range(len(tables))):
        step = tables[k].filter("up is not null").select("tree", "id", "up")
        paths = paths.unionByName(paths.join(step, ["tree", "id"]).select("tree", "branch", (F.col("depth") - F.lit(1 << k)).alias("depth"), F.col("up").alias("id")))
        paths = written(paths, "paths")
    return paths


def _turn(x: Column) -> Column:
    return F.concat(F.lit(OPEN), x.role, F.lit(MIDDLE), x.text, F.lit(CLOSE))


def sound(messages: DataFrame) -> DataFrame:
    """messages (tree, id, parent, role, text, score) with ids that are not null and distinct within their tree: structs of whether it was made up, and the id."""
    kind = "string" if dict(messages.dtypes)["id"] == "string" else "long"
    own = F.struct(F.col("id").isNull().alias("made"), F.coalesce(F.col("id").cast(kind), F.monotonically_increasing_id().cast(kind)).alias("id"))
    parent = F.when(F.col("parent").isNotNull(), F.struct(F.lit(False).alias("made"), F.col("parent").cast(kind).alias("id")))
    rows = messages.select("tree", own.alias("id"), F.struct(parent.alias("parent"), "role", "text", "score").alias("row"))
    rows = written(rows, "messages")  # so that a number that was made up stays
    return rows.groupBy("tree", "id").agg(F.min("row").alias("row")).select("tree", "id", "row.*")


def format_trees(messages: DataFrame, branches: int = 1, distinct: bool = False) -> DataFrame:
    """messages (tree, id, parent, role, text, score) -> (tree, branch, formatted, loss_mask): loss_mask has start and end of each assistant text, in code points.

    A conversation becomes one value, so it has to fit into a row; conversations never share a task's memory otherwise. Messages of
    a null tree are one tree. distinct: ids are known to be distinct within their tree and not null.
    """
    kind = dict(messages.dtypes)["tree"]
    messages = messages.withColumn("tree", F.coalesce(F.concat(F.lit("v"), F.col("tree").cast("string")), F.lit("n")))
    messages = messages if distinct else sound(messages)
    paths = choose_paths(messages.select("tree", "id", "parent", "score"), branches)
    texts = messages.select("tree", "id", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.coalesce("role", F.lit("")) == ASSISTANT).alias("learn"))
    whole = paths.join(texts, ["tree", "id"]).groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text", "learn"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", _turn), "").alias("formatted")
    ends = running(F.transform("turns", lambda x: F.char_length(_turn(x)).cast("long")))
    spans = F.zip_with("turns", ends, lambda x, end: F.when(x.learn, F.struct((end - len(CLOSE) - F.char_length(x.text)).alias("start"), (end - len(CLOSE)).alias("end"))))
    name = F.when(F.col("tree") != "n", F.substring("tree", 2, 100_000).cast(kind)).alias("tree")
    return whole.select(name, "branch", formatted, F.filter(spans, lambda s: s.isNotNull()).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text), read from `formatted`, and loss_text, the unescaped text under the mask."""
    body = F.split("formatted", CLOSE, -1)
    head = rf"^(?s){OPEN}([^:\n]*){MIDDLE}(.*)$"
    turns = F.transform(F.slice(body, 1, F.size(body) - 1), lambda t: F.struct(unescape(F.regexp_extract(t, head, 1)).alias("role"), unescape(F.regexp_extract(t, head, 2)).alias("text")))
    under = F.array_join(F.transform(texts_at(F.col("formatted"), F.col("loss_mask")), unescape), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", under)


def linear(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("id", place)
    return rows.select(F.col("conv_id").alias("tree"), "id", (F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
