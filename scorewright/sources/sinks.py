"""Sinks: tables are written by executors; only reports of bounded size are made on the driver."""

from __future__ import annotations

import io
import json
import zipfile
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import comparison_png
from .folders import place
from .readers import materialize_binary


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, in any store that Spark writes."""
    files, target = place(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written and read back: its side effects, such as files, are done once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json_document(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, default=str))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_run(df: DataFrame, path: str, run: str, model: str, task: str) -> None:
    """Samples or metrics of a task, partitioned so that a run, model or task is read alone; a repeated write replaces its own partition."""
    keyed = df.withColumns({"run_id": F.lit(run), "model": F.lit(model), "task": F.lit(task)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "model", "task").parquet(path)


def write_buckets(df: DataFrame, path: str, bucket: str = "bucket") -> None:
    df.write.mode("overwrite").partitionBy(bucket).parquet(path)


def _sheet_column(n: int) -> str:
    """A, B, ... Z, AA, ..."""
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def xlsx_bytes(columns: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet: a row of names, then the rows; numbers and booleans as such, all else as text, nothing for null."""

    def cell(y: int, x: int, v: Any) -> str:
        at = f"{_sheet_column(x)}{y}"
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) and v not in (float("inf"), float("-inf")):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        text = "".join(c for c in str(v) if c in "\t\n\r" or c >= " ")
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    main, kind = "http://schemas.openxmlformats.org", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    body = "".join(f'<row r="{y}">{"".join(cell(y, x, v) for x, v in enumerate(r))}</row>' for y, r in enumerate([tuple(columns), *rows], 1))
    link = lambda to, what: f'<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument/2006/relationships/{what}" Target="{to}"/></Relationships>'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": link("xl/workbook.xml", "officeDocument"),
        "xl/workbook.xml": f'<workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": link("worksheets/sheet1.xml", "worksheet"),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in files.items():
            book.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{text}')
    return out.getvalue()


def table_statistics(df: DataFrame) -> dict[str, Any]:
    """Models, columns and columns of doubles of a leaderboard."""
    n = df.count()
    return {"total_models": n, "columns": df.columns, "numeric_columns": [c for c, t in df.dtypes if t == "double"], "models_count": n}


def write_table(df: DataFrame, path: str, formats: tuple[str, ...] = ("json", "csv"), most_models: int = 1_000_000) -> None:
    """A leaderboard: a row a model, so one file. `xlsx` and `stats` are made on the driver; a workbook holds at most most_models rows, more raise."""
    one = df.coalesce(1)
    if "json" in formats:
        one.write.mode("overwrite").json(f"{path}.json")
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in df.dtypes]
    if "csv" in formats:
        one.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    if "xlsx" in formats:
        rows = df.select(*flat).limit(most_models + 1).collect()
        if len(rows) > most_models:
            raise ValueError(f"more than {most_models} rows")
        write_bytes(df.sparkSession, f"{path}.xlsx", xlsx_bytes(df.columns, [tuple(r) for r in rows]))
    if "stats" in formats:
        write_json_document(df.sparkSession, f"{path}_statistics.json", table_statistics(df))


def append_status(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def metrics_report(title: str, metrics: dict[str, Any]) -> str:
    """A text report of aggregate metrics, nested ones indented."""

    def lines(node: dict, depth: int) -> list[str]:
        out = []
        for k, v in node.items():
            if isinstance(v, dict):
                out += [f"{'  ' * depth}{k}:", *lines(v, depth + 1)]
            else:
                out.append(f"{'  ' * depth}{k}: {v:.4f}" if isinstance(v, float) else f"{'  ' * depth}{k}: {v}")
        return out

    return "\n".join([title, "=" * len(title), *lines(metrics, 0)]) + "\n"


def diagnostics_report(worst: DataFrame, hallucinated: DataFrame) -> str:
    """Of tables that are cut to their first rows already."""
    out = ["Worst fields"]
    out += [f"  {r.field}: {r.exact_accuracy:.1%} exact of {r.expected_count} ({r.band})" for r in worst.collect()]
    out += ["Hallucinated fields", *(f"  {r.field}: {r.spurious_count}" for r in hallucinated.collect())]
    return "\n".join(out) + "\n"


def package_submission(spark: SparkSession, run: str, target: str, models: list[str], manifest: dict[str, Any]) -> None:
    """Copies each model's run folder inside the store, and writes a manifest."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for model in models:
        a, b = (jvm.org.apache.hadoop.fs.Path(f"{p}/{model}") for p in (run, f"{target}/models"))
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    write_json_document(spark, f"{target}/manifest.json", manifest | {"models": models})


def group_summary(model: str, stamp: str, aggregated: dict[str, Any], subtasks: dict[str, dict[str, Any]]) -> dict[str, Any]:
    return {"model": model, "timestamp": stamp, "subtasks": list(subtasks), "aggregated_metrics": aggregated, "per_subtask_metrics": subtasks}


def write_group_summary(spark: SparkSession, folder: str, title: str, model: str, stamp: str, aggregated: dict[str, Any], subtasks: dict[str, dict[str, Any]]) -> None:
    """`<model>_<stamp>_summary` as JSON and as a text report."""
    path = f"{folder.rstrip('/')}/{model.replace('/', '_')}_{stamp}_summary"
    write_json_document(spark, f"{path}.json", group_summary(model, stamp, aggregated, subtasks))
    head = {"Model": model, "Timestamp": stamp, "Subtasks": ", ".join(subtasks)}
    write_text(spark, f"{path}.txt", metrics_report(title, head | {"Aggregated": aggregated, "By subtask": subtasks}))


def performance_summary(samples: int, seconds: float, errors: int = 0) -> dict[str, Any]:
    """Duration and throughput of a task, for its summary."""
    return {"total_samples": samples, "total_duration": round(seconds, 6), "throughput": samples / seconds if seconds > 0 else 0.0, "seconds_per_sample": seconds / samples if samples else 0.0, "error_count": errors}


def write_mask_comparisons(df: DataFrame, folder: str, ident: str, predicted: str = "predicted", expected: str = "expected", picture: Column | str | None = None) -> DataFrame:
    """(ident, file_path): a PNG of each sample whose two images can be read, written by executors."""
    rows = df.select(F.col(ident), F.col(ident).cast("string").alias("record_id"), comparison_png(predicted, expected, picture).alias("_png"), F.lit("png").alias("ext"), F.lit(0).alias("row_idx"))
    return materialize_binary(rows.filter("_png is not null"), "_png", folder).select(ident, "file_path")
