"""Field mapping: raw rows to samples (id, text, expected and what the task needs)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import col, strip
from ..sources.folders import new_folder

#: Task fields that keep their names in samples.
TASK_FIELDS = ("schema", "choices", "choice_labels", "label_to_index", "label_value", "image_path", "file_path", "record_id", "locale")


@dataclass(frozen=True)
class FieldMap:
    """Names of the raw columns; ground truth from columns (column -> dotted path) or one output column."""

    id: str = "id"
    text: str = "text"
    expected: str = "expected"
    renames: dict[str, str] = field(default_factory=dict)  # raw column -> sample column
    ground_truth: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)  # path -> JSON type


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_idx") -> DataFrame:
    """Consecutive numbers from 0 in a total order, without one task for all rows.

    Rows are range-partitioned by the order, sorted, and written to the shared folder, a file a partition: Spark draws the bounds of
    ranges from a sample, anew in every exchange, and may merge its partitions in another way, so only what is written has the same
    partitions for rows and counts. A row's number is its place in its file after the rows of the files before. The counts are as many
    rows as there are partitions.
    """
    order, spark = [col(o) for o in order], df.sparkSession
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]  # not held by Parquet
    parts = df.drop(*void).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*order)
    path = new_folder(spark, "numbered")
    parts.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    rows = spark.read.schema(parts.schema).parquet(path)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__start", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    placed = rows.withColumn("__inside", F.col("_metadata.row_index")).join(F.broadcast(starts), "__part")
    return placed.withColumns({c: F.lit(None) for c in void} | {name: F.col("__start") + F.col("__inside")}).drop("__part", "__inside", "__start")


def _typed(value: Column, kind: str) -> Column:
    """A ground-truth column as its JSON type; null where it can't be read, which leaves the field out."""
    text = value.cast("string")
    if kind == "integer":
        return F.coalesce(text.try_cast("long"), F.when(text.try_cast("double") % 1 == 0, text.try_cast("double").cast("long")))
    if kind == "number":
        return text.try_cast("double")
    if kind == "boolean":
        return text.try_cast("boolean")
    return text


def ground_truth(df: DataFrame, mapping: dict[str, str], types: dict[str, str] | None = None) -> Column:
    """JSON text of the nested object; null ground truth is left out, array columns hold JSON lists or native arrays."""
    types, tree = types or {}, {}
    kinds = dict(df.dtypes)
    for column, path in mapping.items():
        if column not in kinds:
            continue
        if types.get(path) == "array" and kinds[column] == "string":
            value = F.from_json(F.col(column), "array<string>")
            value = F.when(F.try_parse_json(F.col(column)).isNotNull() & F.col(column).rlike(r"^\s*\["), value)
        elif kinds[column].startswith(("array", "map", "struct")):
            value = F.col(column)
        else:
            value = _typed(F.col(column), types.get(path, "string"))
        node = tree
        *above, leaf = path.split(".")
        for name in above:
            node = node.setdefault(name, {})
        node[leaf] = value

    def built(node: dict) -> Column:
        return F.struct(*((built(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()))

    return F.to_json(built(tree), {"ignoreNullFields": "true"}) if tree else F.lit(None).cast("string")


def normalize_samples(df: DataFrame, fields: FieldMap = FieldMap(), index: str | None = "row_idx", prefix: str = "sample") -> DataFrame:
    """Samples of raw rows; a row without text (or a file path), or without its expected value, is dropped.

    Ids are the id column as text, else prefix and six digits of the `index` column. Columns not mapped are kept.
    """
    if {"id", "text"} <= set(df.columns) and ({"expected", fields.expected} & set(df.columns)) and fields.id not in df.columns:
        fields = FieldMap(expected=fields.expected, renames=fields.renames, ground_truth=fields.ground_truth, types=fields.types)
    have = set(df.columns)
    made = F.format_string(f"{prefix}_%06d", F.col(index)) if index and index in have else F.lit(None).cast("string")
    ident = F.coalesce(F.col(fields.id).cast("string"), made) if fields.id in have else made
    text = F.coalesce(*(F.col(c).cast("string") for c in (fields.text, "file_path") if c in have), F.lit(None).cast("string"))
    expected = ground_truth(df, fields.ground_truth, fields.types) if fields.ground_truth else F.col(fields.expected) if fields.expected in have else F.col("expected") if "expected" in have else F.lit(None).cast("string")
    used = {fields.id, fields.text, fields.expected, *fields.renames, "id", "text", "expected"}
    renamed = [F.col(a).alias(b) for a, b in fields.renames.items() if a in have]
    rest = [F.col(c) for c in df.columns if c not in used and c not in set(fields.renames.values())]
    return df.select(ident.alias("id"), text.alias("text"), expected.alias("expected"), *renamed, *rest).filter("text is not null and expected is not null")


def labelled_choices(df: DataFrame, label: Column | str, labels: dict[str, str]) -> DataFrame:
    """Adds choices, choice_labels, label_to_index and expected: choices in the order of the sorted labels. Unknown labels are dropped.

    The label dimension is a literal map in the plan, so there is no join.
    """
    items = sorted(labels.items())
    index = F.create_map(*(x for i, (k, _) in enumerate(items) for x in (F.lit(k), F.lit(i))))
    out = df.withColumns(
        {
            "choices": F.array(*(F.lit(v) for _, v in items)),
            "choice_labels": F.array(*(F.lit(chr(65 + i)) for i in range(len(items)))),
            "label_to_index": index,
            "expected": F.try_element_at(index, strip(col(label).cast("string"))),
        }
    )
    return out.filter("expected is not null")


def choice_rows(df: DataFrame, task: str, index: str = "row_idx") -> DataFrame:
    """Rows that hold their choices already: an id `<task>_<number>` where there is none."""
    made = F.concat(F.lit(f"{task}_"), F.col(index).cast("string"))
    return df.withColumn("id", F.coalesce(F.col("id").cast("string"), made) if "id" in df.columns else made)


def freeform_rows(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in ("id", "text", "expected"))).dropna(subset=["text", "expected"])


def structured_rows(df: DataFrame, schema: str | None = None) -> DataFrame:
    """A schema for all rows, or one a row; rows without text, expected value or schema are dropped."""
    out = df.withColumn("schema", F.lit(schema)) if schema is not None else df
    keep = [c for c in ("id", "text", "expected", "schema", "record_id", "image_path") if c in out.columns]
    return out.select(*keep).dropna(subset=["text", "expected", "schema"])


def translation_rows(df: DataFrame) -> DataFrame:
    """source_text becomes text, target_text expected."""
    return df.withColumns({"text": F.coalesce("source_text", F.lit("")), "expected": F.coalesce("target_text", F.lit(""))}).drop("source_text", "target_text")


def exam_choices(choices: Column, kind: str) -> tuple[Column, Column]:
    """Texts and labels of a struct of arrays (text, label), an array of structs (text, label) or an array of texts; labels A to E by default."""
    letters = F.array(*map(F.lit, "ABCDE"))
    if kind == "arrays":
        return choices.text, F.coalesce(choices.label, F.slice(letters, 1, F.size(choices.text)))
    if kind == "structs":
        return F.transform(choices, lambda c: c.text), F.transform(choices, lambda c, i: F.coalesce(c.label, F.get(letters, i)))
    return choices, F.slice(letters, 1, F.size(choices))


def filled(expected: Column | str, schema: T.StructType) -> Column:
    """A JSON object cut down to the schema's fields, missing ones null and missing arrays empty."""

    def fill(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(fill(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            full = F.transform(value, lambda x: fill(x, inner)) if isinstance(inner, T.StructType) else value
            return F.coalesce(full, F.array().cast(full_type(kind)))
        return value

    def full_type(kind: T.ArrayType) -> str:
        return kind.simpleString()

    return fill(F.from_json(col(expected), schema), schema)


def with_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of the split by a column split, subset or partition, or a flag is_<split>; all rows if none match."""
    named = next((c for c in ("split", "subset", "partition") if c in df.columns), None)
    flag = f"is_{split}"
    if named:
        chosen = df.filter(F.lower(F.col(named)) == split.lower())
    elif flag in df.columns:
        chosen = df.filter(F.col(flag).cast("boolean"))
    else:
        return df
    return df if chosen.isEmpty() else chosen


def limited(df: DataFrame, n: int | None, order: str = "row_idx", zero_is_all: bool = False) -> DataFrame:
    return df if n is None or (zero_is_all and n == 0) else df.orderBy(order).limit(n)
