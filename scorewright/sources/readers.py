"""Scans. Each is a dispatch on the driver and a lazy read; schemas are explicit or come from the file's own metadata."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsons import plain_schema
from ..functions.text import strip
from ..operators.mapping import FieldMap, limited, normalize_samples, numbered, with_split
from .folders import place

IMAGES = ("jpg", "jpeg", "png", "gif", "webp")
EXTENSION_COLUMNS = ("input_file_extension", "file_extension", "extension", "ext")
ID_COLUMNS = ("record_id", "id", "attachment_id")


def exists(spark: SparkSession, path: str) -> bool:
    """In any store that Spark reads."""
    fs, target = place(spark, path)
    return fs.exists(target)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted."""
    fs, target = place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = place(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def detect_source(spark: SparkSession, name: str) -> str:
    """parquet, jsonl, directory or hub."""
    if is_folder(spark, name):
        inner = listed(spark, name) + listed(spark, f"{name}/data")
        return "parquet" if name.endswith(".parquet") or any(x.endswith(".parquet") for x in inner) else "directory"
    if exists(spark, name):
        return {"parquet": "parquet", "jsonl": "jsonl"}.get(name.rsplit(".", 1)[-1], "hub")
    return "jsonl" if name.endswith(".jsonl") else "hub"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Blank lines are passed over; a broken line raises. row_idx follows the file, then the line."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """A file, or of a folder the `<split>.parquet`, else its first file by name; row_idx is the row's place."""
    target = path
    if is_folder(spark, path):
        base = f"{path}/data" if is_folder(spark, f"{path}/data") else path
        names = [n for n in listed(spark, base) if n.endswith(".parquet") and not n.startswith("part-")]
        if f"{split}.parquet" in names:
            target = f"{base}/{split}.parquet"
        elif names:
            target = f"{base}/{names[0]}"
    return spark.read.parquet(target)


def file_path() -> Column:
    """The path that a row was read from, as it is written; the metadata column holds it as an encoded URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Consecutive numbers in file order, from the reader's own metadata: exact for one file, and for many by path."""
    return numbered(df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}), ["_file", "_row"], name).drop("_file", "_row")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or TSV as text columns; a byte-order mark and blanks around names are dropped, quotes may span lines."""
    df = spark.read.option("header", header).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_tsv_lines(spark: SparkSession, path: str, prefix: str, columns: tuple[str, str] = ("text", "expected")) -> DataFrame:
    """Lines of two fields or more; blank and short ones are passed over, ids `<prefix>_<n>` count the rest from 0."""
    lines = spark.read.text(path).withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    parts = F.split(strip("value"), "\t")
    rows = numbered(lines.filter(F.size(parts) >= 2), ["_file", "_at"])
    return rows.select(F.concat(F.lit(f"{prefix}_"), F.col("row_idx").cast("string")).alias("id"), strip(parts[0]).alias(columns[0]), strip(parts[1]).alias(columns[1]))


def read_labelled_csv(spark: SparkSession, path: str, label: str, allowed: tuple[str, ...] | None = None, integer: bool = False) -> DataFrame:
    """Rows with a label that can be read, or is one of the allowed ones in any case."""
    df = read_delimited(spark, path)
    value = F.lower(strip(label))
    if integer:
        return df.withColumn(label, strip(label).try_cast("int")).filter(F.col(label).isNotNull())
    return df.withColumn(label, value).filter(value.isin(*allowed) if allowed else value != "")


def read_json_array(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).drop(*drop)


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) of a JSON object; values as JSON text, or a given type. One object is one record, so a file is read whole."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_json_records(spark: SparkSession, path: str, key: str = "id", allowed: str | None = None) -> DataFrame:
    """(key, value JSON text) of a file that holds a list of objects or an object of them; allowed: a file of keys, a line each, that alone are kept."""
    whole = spark.read.text(path, wholetext=True)
    listing = F.from_json("value", "array<string>")
    by_list = F.transform(listing, lambda x: F.struct(F.get_json_object(x, f"$.{key}").alias("key"), x.alias("value")))
    by_map = F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: F.struct(e.key.alias("key"), e.value.alias("value")))
    return whole.select(F.explode(F.when(F.ltrim("value").startswith("["), by_list).otherwise(by_map)).alias("r")).select("r.*") if allowed is None else read_json_records(spark, path, key).join(allowed_keys(spark, allowed), "key", "left_semi")


def allowed_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a text file: its lines, without blanks around them and without empty ones."""
    return spark.read.text(path).select(strip("value").alias("key")).filter("key <> ''").distinct()


def read_expected(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "pdf")) -> DataFrame:
    """(id, expected, schema, file_path) of a folder with expected.json (file stem -> object) and schema.json; of several files of a stem the first extension in order; without a file, no row."""
    from ..operators.joins import with_listing

    rows = read_json_map(spark, f"{path}/expected.json").select(F.regexp_replace("key", r"\.(" + "|".join(extensions) + ")$", "").alias("stem"), F.col("value").alias("expected"))
    schema = spark.read.text(f"{path}/schema.json", wholetext=True).first()[0]
    met = with_listing(rows, file_listing(spark, path, extensions), "stem", list(extensions))
    return met.select(F.col("stem").alias("id"), "expected", F.lit(schema).alias("schema"), F.col("path").alias("file_path"))


def file_listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, stem, ext) of the files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.substring_index("path", "/", -1)
    out = df.withColumns({"ext": F.lower(F.substring_index(name, ".", -1)), "stem": F.regexp_replace(name, r"\.[^.]*$", "")})
    return out.filter(F.col("ext").isin(*extensions))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """metadata.jsonl with paths made absolute, else one row an image with ids dir_000000 in order of path."""
    if exists(spark, f"{path}/metadata.jsonl"):
        df = read_jsonl(spark, f"{path}/metadata.jsonl")
        full = lambda c: F.when(F.col(c).rlike(r"^(/|\w+:)"), F.col(c)).otherwise(F.concat(F.lit(f"{path}/"), F.col(c)))
        return df.withColumns({c: full(c) for c in ("file_path", "image_path", "file_name") if c in df.columns})
    return numbered(file_listing(spark, path), ["path"]).select(F.format_string("dir_%06d", "row_idx").alias("id"), F.col("path").alias("file_path"), "stem", "ext")


def image_mask_pairs(spark: SparkSession, images: str, masks: str, priority: tuple[str, ...] = ("png", "jpg", "jpeg", "webp")) -> DataFrame:
    """(stem, image_path, mask_path), of several images of a stem the first extension in order."""
    from ..operators.joins import with_listing

    m = file_listing(spark, masks, priority).groupBy("stem").agg(F.min("path").alias("mask_path"))
    return with_listing(m, file_listing(spark, images, priority), "stem", list(priority)).select("stem", F.col("path").alias("image_path"), "mask_path")


def materialize_binary(df: DataFrame, column: str, folder: str, index: str = "row_idx", default_ext: str = "bin") -> DataFrame:
    """Writes each payload to `<id>.<ext>` in a folder that executors share (a path, or a URI of any store that Arrow writes), and adds file_path.

    A repeated task writes the same files again, so a lost executor does no harm.
    """
    ids = [F.col(c).cast("string") for c in ID_COLUMNS if c in df.columns]
    ext = [F.ltrim(F.col(c), F.lit(".")) for c in EXTENSION_COLUMNS if c in df.columns]
    ready = df.withColumns({"_id": F.coalesce(*ids, F.format_string("row_%06d", F.col(index))), "_ext": F.coalesce(*ext, F.lit(default_ext))})
    ready = ready.withColumn("file_path", F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace("_id", r"[^\w.-]", "_"), F.lit("."), "_ext"))

    def save(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for data, path in zip(batch.column(column).to_pylist(), batch.column("file_path").to_pylist(), strict=True):
                if data is not None:
                    name = f"{base.rstrip('/')}/{path.rsplit('/', 1)[-1]}"
                    with store.open_output_stream(part := f"{name}.{uuid.uuid4().hex}") as f:
                        f.write(data)
                    store.move(part, name)
            yield batch.drop_columns([column])

    kept = [c for c in ready.columns if c not in ("_id", "_ext")]
    ready = ready.select(*kept)
    return ready.mapInArrow(save, T.StructType([f for f in ready.schema.fields if f.name != column]))


def speech_samples(df: DataFrame, folder: str, locale: str, language: str, audio: str = "audio.bytes") -> DataFrame:
    """(id, audio_path, expected, language, locale) of rows (id, audio, transcription): the bytes as they are go to `<id>.wav` in the folder; a row without audio is dropped."""
    rows = df.select(F.col("id").cast("string").alias("record_id"), F.col(audio).alias("_audio"), F.col("transcription").alias("expected"), F.lit("wav").alias("ext"), F.lit(0).alias("row_idx"))
    saved = materialize_binary(rows.filter("_audio is not null"), "_audio", folder)
    return saved.select(F.concat(F.lit(f"{locale}_"), "record_id").alias("id"), F.col("file_path").alias("audio_path"), "expected", F.lit(language).alias("language"), F.lit(locale).alias("locale"))


def mapping_fingerprint(config: dict[str, Any]) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:10]


def cached(spark: SparkSession, path: str, build, schema: T.StructType | None = None) -> DataFrame:
    """A view that is written once and read afterwards; a half-written folder has no _SUCCESS and is built again."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    source: str = "auto"
    split: str = "test"
    fields: FieldMap = field(default_factory=FieldMap)
    limit: int | None = None
    fetch: Any = None  # (spark, name, split) -> DataFrame, for hubs


def _fetched(spark: SparkSession, cfg: DatasetConfig) -> DataFrame:
    """The split from the hub; a data set without a test split gives its train split."""
    try:
        return cfg.fetch(spark, cfg.name, cfg.split)
    except Exception:
        if cfg.split != "test":
            raise
        return cfg.fetch(spark, cfg.name, "train")


def load_dataset(spark: SparkSession, cfg: DatasetConfig, cache: str | None = None) -> DataFrame:
    """Scan, number, map and limit; without a name or with an unknown source it raises."""
    if not cfg.name:
        raise ValueError("a data set needs a name")
    kind = detect_source(spark, cfg.name) if cfg.source == "auto" else cfg.source
    if kind == "parquet":
        raw = with_row_index(read_parquet(spark, cfg.name, cfg.split))
    elif kind in ("jsonl", "local"):
        df = read_jsonl(spark, cfg.name)
        raw = numbered(df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()}), ["_file", "_at"]).drop("_file", "_at")
    elif kind == "directory" and (file := next((f"{cfg.name}/{cfg.split}.{e}" for e in ("csv", "tsv") if exists(spark, f"{cfg.name}/{cfg.split}.{e}")), None)):
        df = read_delimited(spark, file, "\t" if file.endswith(".tsv") else ",")
        raw = numbered(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"]).drop("_at")
    elif kind == "directory":
        raw = read_directory(spark, cfg.name)
    elif kind in ("hub", "huggingface"):
        if cfg.fetch is None:
            raise ValueError(f"{cfg.name}: a hub needs a fetch function")
        build = lambda: _fetched(spark, cfg)
        raw = cached(spark, f"{cache}/{cfg.name.replace('/', '_')}_{cfg.split}_{mapping_fingerprint(cfg.fields.__dict__)}", build) if cache else build()
    else:
        raise ValueError(f"unknown source {kind}")
    return limited(normalize_samples(with_split(raw, cfg.split), cfg.fields), cfg.limit, "id" if "row_idx" not in raw.columns else "row_idx")


def dataset_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, labels, has_schema) of the data sets below a folder that have dataset_info.json."""
    rows = []
    for name in listed(spark, root):
        if exists(spark, f"{root}/{name}/dataset_info.json"):
            info = json.loads(spark.read.text(f"{root}/{name}/dataset_info.json", wholetext=True).first()[0])
            rows.append((name, f"{root}/{name}", sorted(map(str, info.get("label_distribution", {}))), exists(spark, f"{root}/{name}/schema.json")))
    return spark.createDataFrame(rows, "name string, path string, labels array<string>, has_schema boolean")


def resolve_dataset(spark: SparkSession, root: str, name: str) -> tuple[str, dict, FieldMap]:
    """Path, plain schema and field map of a data set of the catalog."""
    path = name if exists(spark, name) else f"{root}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(name)
    if not exists(spark, f"{path}/schema.json"):
        return path, {}, FieldMap()
    schema, columns, types = plain_schema(json.loads(spark.read.text(f"{path}/schema.json", wholetext=True).first()[0]))
    return path, schema, FieldMap(id="record_id", ground_truth=columns, types=types)


# Run artifacts


def run_metrics(spark: SparkSession, root: str, schema: T.StructType | str | None = None) -> DataFrame:
    """`*_metrics.json` below a run folder (`<run>/<model>/<task>[/<subtask>]/...`) with model, task key and file time; per-sample files are passed over."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_metrics.json")
    df = (reader.schema(schema) if schema else reader).json(root).withColumns({"_path": file_path(), "_time": F.col("_metadata.file_modification_time")})
    files, target = place(spark, root)
    inner = F.split(F.regexp_extract("_path", rf"\Q{files.makeQualified(target).toUri().getPath()}/\E(.*)$", 1), "/")
    n = F.size(inner) - 1  # without the file
    key = F.when(n >= 3, F.concat(inner[1], F.lit("."), inner[2])).when(n == 2, inner[1]).otherwise(F.lit("main"))
    return df.filter(~F.col("_path").contains("per_sample_metrics")).withColumns({"run_model": inner[0], "task_key": key})


def latest_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The newest `*_summary.json` of each folder by name, performance summaries apart."""
    from ..operators.ranking import latest

    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_summary.json").json(root)
    df = df.withColumns({"file": F.substring_index(file_path(), "/", -1), "folder": F.regexp_replace(file_path(), "/[^/]*$", "")})
    return latest(df.filter(~F.col("file").endswith("_performance_summary.json")), ["folder"], ["file"])


def submissions(spark: SparkSession, root: str) -> DataFrame:
    """model_summary.json of all submissions; of a model, the one last by path."""
    from ..operators.ranking import latest

    df = spark.read.option("multiLine", True).json(f"{root}/*/models/*/model_summary.json").withColumn("path", file_path())
    return latest(df, ["model_name"], ["path"])
