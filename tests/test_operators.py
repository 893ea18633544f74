"""Operators, sources, sinks, tasks, resume and streaming on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from scorewright.functions.metrics import REGISTRY
from scorewright.operators import joins, leaderboard, mapping, ranking, resume, status, structured
from scorewright.plans import config, tasks
from scorewright.sources import readers, sinks
from scorewright.streaming import scoring


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_numbered_is_consecutive(spark):
    got = mapping.numbered(spark.range(1000).withColumn("k", F.col("id") % 7), ["k", "id"]).orderBy("k", "id").collect()
    assert [r.row_idx for r in got] == list(range(1000))


@pytest.fixture
def many_ranges(spark):
    """Ranges stay apart and their bounds are drawn from a part of the rows, as they are on large tables."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "5"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbered_over_sampled_ranges(many_ranges):
    """F1, generated_ids: columns beside the order, some that Parquet can't hold; descending, with nulls."""
    rows = many_ranges.range(5000).select(F.when(F.col("id") % 50 != 0, F.col("id") % 700).alias("k"), "id", F.lit(None).alias("none"), F.col("id").cast("string").alias("a.b"))
    got = mapping.numbered(rows.repartition(6), [F.col("k").desc_nulls_last(), "id"], "at")
    assert sorted(got.columns) == ["a.b", "at", "id", "k", "none"] and dict(got.dtypes)["none"] == "void"
    want = sorted(((i % 700 if i % 50 else None, i) for i in range(5000)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.at, r.k, r.id, r["a.b"]) for r in got.orderBy("at").collect()] == [(n, k, i, str(i)) for n, (k, i) in enumerate(want)]


def test_generated_ids_over_sampled_ranges(many_ranges):
    rows = many_ranges.range(5000).select((F.col("id") * 7919 % 5000).alias("key"), F.col("id").cast("string").alias("text"), F.lit("x").alias("expected"))
    got = mapping.normalize_samples(mapping.numbered(rows, ["key"]), mapping.FieldMap(id="none"))
    assert [(r.id, r.text) for r in got.orderBy("id").collect()] == [(f"sample_{k:06}", str(i)) for k, i in sorted((i * 7919 % 5000, i) for i in range(5000))]


def test_jsonl_rows_over_sampled_ranges(many_ranges, tmp_path):
    """F2, jsonl_scan: no row is lost, and numbers follow the files, then their lines."""
    texts = [None if i % 10 == 0 else f"t{i}" for i in range(5000)]
    for at in range(2):
        (tmp_path / f"{at}.jsonl").write_text("".join(json.dumps({"question": x, "answer": "a"}) + "\n\n" for x in texts[2500 * at : 2500 * (at + 1)]))
    config = readers.DatasetConfig(str(tmp_path), "jsonl", fields=mapping.FieldMap(text="question", expected="answer"))
    got = readers.load_dataset(many_ranges, config).orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [(f"sample_{i:06}", x) for i, x in enumerate(texts) if x]


def test_tsv_lines_over_sampled_ranges(many_ranges, tmp_path):
    """F3, line_scan."""
    lines = ["" if i % 7 == 0 else f"n{i}" if i % 5 == 0 else f"n{i}\t{i % 9}\tmore" for i in range(5000)]
    for at in range(2):
        (tmp_path / f"{at}.txt").write_text("\n".join(lines[2500 * at : 2500 * (at + 1)]))
    got = readers.read_tsv_lines(many_ranges, str(tmp_path), "line").collect()
    want = [x.split("\t") for x in lines if "\t" in x]
    assert sorted(map(tuple, got)) == sorted((f"line_{n}", x[0], x[1]) for n, x in enumerate(want))


def test_ground_truth_cases(spark):
    df = spark.createDataFrame([("1", '["a","b"]', 3.0, None), ("2", "not json", 2.5, "x"), ("3", '{"a":1}', None, "y")], "record_id string, gt_items string, gt_n double, gt_name string")
    out = mapping.ground_truth(df, {"gt_items": "items", "gt_n": "n", "gt_name": "who.name", "gt_absent": "z"}, {"items": "array", "n": "integer"})
    assert [json.loads(r[0]) for r in df.select(out).collect()] == [{"items": ["a", "b"], "n": 3, "who": {}}, {"who": {"name": "x"}}, {"who": {"name": "y"}}]


def test_split_and_limit(spark):
    df = spark.createDataFrame([(0, "Test"), (1, "train")], "row_idx long, split string")
    assert mapping.with_split(df, "test").count() == 1 and mapping.with_split(df, "dev").count() == 2
    assert mapping.limited(df, 0).count() == 0 and mapping.limited(df, 0, zero_is_all=True).count() == 2


def test_filled(spark):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("a string, b array<string>, c struct<d: int>") if hasattr(T, "_parse_datatype_string") else None
    row = spark.range(1).select(mapping.filled(F.lit('{"a": "x", "z": 1, "c": {"d": 2, "e": 3}}'), schema).alias("v")).first().v
    assert row.asDict(recursive=True) == {"a": "x", "b": [], "c": {"d": 2}}


def test_unordered_alignment(spark):
    p = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "z", 2), (1, "a", 3)], "s long, key string, at long")
    e = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2)], "s long, key string, at long")
    assert [r["key"] for r in joins.align_unordered(p, e, ["s"], "key", "at").orderBy("place").collect()] == ["a", "b", "a", "z"]


def test_by_record_and_listing(spark):
    rows = spark.createDataFrame([(0, "r0"), (1, "r1"), (2, "r2")], "row_idx long, record_id string")
    results = spark.createDataFrame([("r2", "sample_000000"), (None, "sample_000001"), (None, "sample_000001")], "record_id string, sample_id string")
    assert [r.row_idx for r in joins.by_record(results, rows).collect()] == [1, 2]
    files = spark.createDataFrame([("a", "jpg", "/a.jpg"), ("a", "png", "/a.png"), ("b", "txt", "/b.txt")], "stem string, ext string, path string")
    assert dicts(joins.with_listing(spark.createDataFrame([("a",), ("b",)], "stem string"), files, priority=["png", "jpg"])) == [{"stem": "a", "path": "/a.png"}]


def test_median_and_ranks(spark):
    df = spark.createDataFrame([("a", 0.95), ("b", 0.70), ("c", 0.10), ("d", 0.40), ("e", None)], "sample_id string, document_extraction_score double")
    assert ranking.run_metric(df) == "document_extraction_score"
    assert ranking.quartiles(df, "document_extraction_score").first()["median"] == pytest.approx(0.55)
    one = ranking.ranked(df.limit(1), "document_extraction_score", "sample_id").first()
    assert (one.rank_asc, one.rank_desc, one.percentile) == (1, 1, 1.0)
    got = ranking.ranked_in(df.dropna().withColumn("g", F.lit(1)), "document_extraction_score", "sample_id", ["g"]).orderBy("rank_asc").collect()
    assert [r.sample_id for r in got] == ["c", "d", "b", "a"] and got[0].rank_desc == 4


SCHEMA = {"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "email": {"type": "string"}, "items": {"type": "array", "items": {"type": "object"}}}, "required": ["name", "age"]}


def test_structured_scores(spark):
    full = {"name": "Ann Lee", "age": 30, "email": "a@b.c"}
    cases = {
        "perfect": (full, full), "extra": ({**full, "x": 1}, full), "missing": ({"name": "Ann Lee", "age": 30}, full), "wrong_type": ({**full, "age": "30"}, full), "null_word": ({**full, "email": "null"}, {**full, "email": None}), "none": (None, full),
        "unordered": ({**full, "items": [{"k": 2}, {"k": 1}]}, {**full, "items": [{"k": 1}, {"k": 2}]}),
    }
    df = spark.createDataFrame([(k, None if p is None else json.dumps(p), json.dumps(e)) for k, (p, e) in cases.items()], "id string, prediction string, expected string")
    samples, fields = structured.score_samples(df, SCHEMA, structured.StructuredRules(unordered={"items": ("k",)}))
    got = {r["sample_id"]: r for r in dicts(samples)}
    assert got["perfect"]["exact_match"] and got["perfect"]["extraction_quality_score"] == pytest.approx(1.0) and got["unordered"]["exact_match"]
    assert got["extra"]["hallucination_rate"] == pytest.approx(1 / 4) and got["missing"]["field_recall_strict"] == pytest.approx(2 / 3)
    assert not got["wrong_type"]["valid"] and got["wrong_type"]["extraction_quality_score"] == 0 and not got["none"]["valid"]
    whole = dicts(structured.dataset_rollup(samples))[0]
    assert whole["total_samples"] == 7 and whole["valid_samples"] == 4 + ("null_word" in [k for k, r in got.items() if r["valid"]]) and 0 < whole["overall_extraction_quality_score"] < 1
    assert structured.worst_fields(structured.field_diagnostics(fields)).count() >= 3


def test_ignored_tiers_and_patterns(spark):
    rows = [("s", "a[0].x", "1", "number", "integer"), ("s", "b", "Calle 5", "string", "string"), ("s", "skip", "q", "string", "string")]
    df = spark.createDataFrame(rows, "sample_id string, field string, value string, kind string, type string")
    other = df.withColumn("value", F.when(F.col("field") == "b", "C. 5").otherwise(F.col("value")))
    rules = structured.StructuredRules(ignored=("skip",), reliable=("a[].x",), freeform=("b",), abbreviations={"c.": "calle"})
    got = {r.field: r for r in structured.compare_fields(other, df, rules).collect()}
    assert set(got) == {"a[0].x", "b"} and got["a[0].x"].tier == "reliable" and got["b"].match_type == "exact"
    rolled = structured.sample_rollup(structured.compare_fields(other, df, rules), rules).first()
    assert rolled.reliable_f1_partial == 1.0 == rolled.freeform_f1_partial


def test_status_rules(spark):
    rows = [(0, 0, None, None, None), (3, 0, None, None, 1.0), (3, 0, None, 1.0, None), (3, None, 3, None, None), (4, None, 1, None, None), (4, 4, 0, None, None), (4, 4, None, 0.1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, total_samples long, valid_samples long, error_count long, invalid_response_rate double, connectivity_error_rate double")
    got = [(r.status, r.reason) for r in status.with_status(df).orderBy("i").collect()]
    assert got == [("no_samples", "no_samples"), ("failed", "all_connectivity_errors"), ("failed", "all_invalid_responses"), ("failed", "no_valid_samples"), ("degraded", "partial_errors"), ("passed", None), ("degraded", "partial_errors")]
    kinds = ['{"name":"a","age":1}', '{"x":1}', "<table>", '{"a": {"b": [', "x " * 30, "plain"]
    out = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, raw string").select("i", status.structured_class("raw", SCHEMA).alias("c")).orderBy("i").collect()
    assert [r.c for r in out] == ["valid_json_schema", "valid_json_non_schema", "ocr_text_or_markup", "json_truncated", "degenerate_repetition", "json_parse_error"]
    checks = spark.createDataFrame([("m", "chat", True, True, False), ("m", "logprobs", False, False, None)], "model string, name string, ok boolean, required boolean, repeats boolean")
    assert dicts(status.probe_status(checks, ["model"])) == [{"model": "m", "probe_status": "degraded", "risk_flags": ["check_failed:logprobs"]}]


def test_leaderboard(spark):
    rows = spark.createDataFrame([("org/m", "es", "t1", 0.5), ("org/m", "es", "t2", 1.0), ("n", "es", "t1", 0.25)], "model string, category string, task string, score double")
    table = leaderboard.overall(leaderboard.wide(rows), ["es_t1", "es_t2"])
    assert {r.model: r.overall_score for r in table.collect()} == {"org/m": 0.75, "n": 0.25}
    w = leaderboard.transcription_scores(spark.createDataFrame([("m", 0.10), ("m", 0.20)], "model string, wer double"), ["model"])
    assert w.first().score == pytest.approx(0.85)
    merged = leaderboard.merge_models(rows.select("model", F.lit(0).alias("v")).distinct(), spark.createDataFrame([("n", 1), ("new", 1)], "model string, v int"))
    assert {r.model: r.v for r in merged.collect()} == {"org/m": 0, "n": 1, "new": 1}
    legacy = spark.createDataFrame([("m", "t", {"chrf,clean_translation": 50.0}), ("m", "u", {"acc,all": 0.5})], "model string, task string, metrics map<string,double>")
    assert {r.task: r.score for r in leaderboard.legacy_scores(legacy).collect()} == {"t": 0.5, "u": 0.5}


def test_sources(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"sample_id": 1, "question": "q", "answer": "x"}\n\n{"sample_id": 2, "question": null, "answer": "y"}\n', encoding="utf-8")
    fields = mapping.FieldMap(id="sample_id", text="question", expected="answer")
    assert readers.detect_source(spark, f"{d}/a.jsonl") == "jsonl"
    assert [r.id for r in readers.load_dataset(spark, readers.DatasetConfig(f"{d}/a.jsonl", fields=fields)).collect()] == ["1"]
    (tmp_path / "b.csv").write_text("\ufefftexto , tipo \nhola, SPAM\nx,otro\n", encoding="utf-8")
    assert [(r.texto, r.tipo) for r in readers.read_labelled_csv(spark, f"{d}/b.csv", "tipo", ("spam", "ham")).collect()] == [("hola", "spam")]
    (tmp_path / "c.tsv").write_text("q1\t5\n\nbad\nq2\t7\textra\n")
    assert [(r.id, r.text, r.expected) for r in readers.read_tsv_lines(spark, f"{d}/c.tsv", "mgsm").orderBy("id").collect()] == [("mgsm_0", "q1", "5"), ("mgsm_1", "q2", "7")]
    (tmp_path / "m.json").write_text('{"k1": {"a": 1}, "k2": {"a": 2}}')
    assert {r.key: r.value for r in readers.read_json_map(spark, f"{d}/m.json").collect()} == {"k1": '{"a":1}', "k2": '{"a":2}'}
    (tmp_path / "l.json").write_text('[{"id": "x", "v": 1}]')
    assert [r.key for r in readers.read_json_records(spark, f"{d}/l.json").collect()] == ["x"] and [r.key for r in readers.read_json_records(spark, f"{d}/m.json").orderBy("key").collect()] == ["k1", "k2"]
    (tmp_path / "img" / "sub").mkdir(parents=True)
    for n in ("b.png", "a.jpg", "sub/c.gif", "no.txt"):
        (tmp_path / "img" / n).write_bytes(b"1")
    assert [r.id for r in readers.read_directory(spark, f"{d}/img").orderBy("id").collect()] == ["dir_000000", "dir_000001", "dir_000002"]
    assert readers.image_mask_pairs(spark, f"{d}/img", f"{d}/img").count() == 3 - 1
    spark.range(5).selectExpr("id", "cast(id as string) as text", "'e' as expected").coalesce(1).write.parquet(f"{d}/p/data/test.parquet")
    got = readers.load_dataset(spark, readers.DatasetConfig(f"{d}/p", limit=3))
    assert got.count() == 3
    binary = spark.createDataFrame([("r1", bytearray(b"abc"), ".png")], "record_id string, input_bytes binary, ext string").withColumn("row_idx", F.lit(0))
    out = readers.materialize_binary(binary, "input_bytes", f"{d}/bin").collect()
    assert (tmp_path / "bin" / "r1.png").read_bytes() == b"abc" and out[0].file_path.endswith("r1.png")
    (tmp_path / "cat" / "ds").mkdir(parents=True)
    (tmp_path / "cat" / "ds" / "dataset_info.json").write_text('{"label_distribution": {"b": 1, "a": 2}}')
    (tmp_path / "cat" / "ds" / "schema.json").write_text('{"properties": {"n": {"type": "integer", "gt_field": "gt_n"}}}')
    assert dicts(readers.dataset_catalog(spark, f"{d}/cat"))[0]["labels"] == ["a", "b"]
    assert readers.resolve_dataset(spark, f"{d}/cat", "ds")[2].ground_truth == {"gt_n": "n"}
    with pytest.raises(ValueError, match="unknown source"):
        readers.load_dataset(spark, readers.DatasetConfig("x", source="odd"))


def test_run_artifacts_and_sinks(spark, tmp_path):
    d = str(tmp_path)
    for model, task, sub in (("m1", "asr", "es"), ("m1", "asr", "pt"), ("m2", "solo", None)):
        folder = tmp_path / "run" / model / task / (sub or "")
        folder.mkdir(parents=True)
        (folder / "x_metrics.json").write_text('{"metrics": {"wer": 0.1}}')
    got = {(r.run_model, r.task_key) for r in readers.run_metrics(spark, f"{d}/run").collect()}
    assert got == {("m1", "asr.es"), ("m1", "asr.pt"), ("m2", "solo")}
    for n in ("a_1_summary", "a_2_summary", "a_3_performance_summary"):
        (tmp_path / "run" / f"{n}.json").write_text(json.dumps({"name": n}))
    assert [r.name for r in readers.latest_summaries(spark, f"{d}/run").collect()] == ["a_2_summary"]
    df = spark.createDataFrame([("é", 1, None)], "s string, n int, z string")
    sinks.write_jsonl(df, f"{d}/out.jsonl")
    assert "é" in "".join(p.read_text() for p in (tmp_path / "out.jsonl").glob("*.json"))
    sinks.write_run(df, f"{d}/runs", "r", "m", "t")
    sinks.write_run(df, f"{d}/runs", "r", "m", "t")
    assert spark.read.parquet(f"{d}/runs").filter("model = 'm'").count() == 1
    sinks.write_table(df, f"{d}/board")
    sinks.write_json_document(spark, f"{d}/doc.json", {"a": "é"})
    assert json.loads((tmp_path / "doc.json").read_text()) == {"a": "é"} and "a:\n  b: 0.5000" in sinks.metrics_report("T", {"a": {"b": 0.5}})
    sinks.package_submission(spark, f"{d}/run", f"{d}/sub", ["m1"], {"by": "x"})
    assert (tmp_path / "sub" / "models" / "m1" / "asr" / "es" / "x_metrics.json").exists()


def test_resume(spark, tmp_path):
    path = str(tmp_path / "ck")
    samples = spark.createDataFrame([("a",), ("b",)], "id string")
    assert resume.remaining(samples, resume.load_checkpoint(spark, path, "h")).count() == 2
    resume.append_checkpoint(spark.createDataFrame([("a", 1.0)], "sample_id string, f1 double"), path, "h")
    assert [r.id for r in resume.remaining(samples, resume.load_checkpoint(spark, path, "h")).collect()] == ["b"]
    assert resume.load_checkpoint(spark, path, "other").count() == 0


def test_tasks(spark):
    samples = spark.createDataFrame([("1", "q", "Hello  World"), ("2", "q", "bye"), ("3", "q", "x")], "id string, text string, expected string")
    predictions = spark.createDataFrame([("1", "hello world"), ("2", "good bye")], "id string, prediction string")
    out = tasks.evaluate(tasks.ad_hoc("freeform", "t"), samples, tasks.from_table(predictions))
    row = out.metrics.first()
    assert (row.total_samples, row.valid_samples, row.exact_match) == (3, 2, 0.5) and row.f1 == pytest.approx((1 + 2 / 3) / 2)
    speech = tasks.evaluate(tasks.ad_hoc("transcription", "t"), samples.withColumn("locale", F.lit("es")), tasks.from_table(predictions)).metrics.filter("is_total").first()
    assert speech.error_rate == 0.3333
    model = tasks.from_function(lambda texts: [t.upper() for t in texts], batch_rows=2)
    assert {r.prediction for r in model(samples).collect()} == {"Q"}
    broken = tasks.from_function(lambda texts: 1 / 0, attempts=1)
    assert all(r.error.startswith("ZeroDivisionError") and r.error_type == "connectivity_error" for r in broken(samples).collect())
    odd = tasks.from_function(lambda texts: [str(1 // (t != "bad")) for t in texts], attempts=1)
    mixed = odd(spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "ok")], "id string, text string").coalesce(1)).collect()
    assert [(r.prediction, r.error is None) for r in mixed] == [("1", True), (None, False), ("1", True)]
    with pytest.raises(ValueError, match="unknown task"):
        tasks.ad_hoc("odd", "t")
    body = spark.createDataFrame([("1", "t", '{"name": "a", "age": 1}')], "id string, text string, expected string")
    done = tasks.evaluate(tasks.ad_hoc("structured", "t", schema=SCHEMA), body, tasks.from_table(body.select("id", F.col("expected").alias("prediction"))))
    assert done.metrics.first().exact_match_rate == 1.0 and set(done.artifacts) == {"fields", "field_diagnostics"}


def test_config():
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, None) == {"a": {"b": 3, "c": 2}}
    assert config.validate_task({"task_type": "freeform", "dataset": {"name": "x"}}) == [] and len(config.validate_task({})) == 2
    assert config.expand_groups(["g", "t1"], {"g": ["t1", "h"], "h": ["t2", "g"]}) == ["t1", "t2"]
    assert config.redacted(["--api-key", "s", "--x=1", "--token=q"]) == ["--api-key", "***", "--x=1", "--token=***"]
    assert config.compatible({"vision": "required", "logprobs": "preferred"}, {"vision": True}) == (True, ["logprobs"])
    assert config.restricted({"a": True, "b": False}, {"a": False, "b": True}) == {"a": False, "b": False}
    assert config.run_id("20240101", limited=True) == "20240101_LIMITED" and config.allowed_tasks(["a.b", "c"], ["a"]) == ["a.b"]


def test_streaming(spark, tmp_path):
    d = str(tmp_path)
    rows = spark.createDataFrame([("1", "x", "2024-01-01 00:01:00"), ("1", "x", "2024-01-01 00:02:00"), ("2", "y z", "2024-01-01 00:12:00")], "id string, prediction string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{d}/in")
    samples = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, expected string")
    stream = scoring.score_stream(spark.readStream.schema(rows.schema).parquet(f"{d}/in"), samples, ["exact_match", "f1"])
    scoring.write_scores(stream, f"{d}/out", f"{d}/ck").awaitTermination(60)
    got = spark.read.parquet(f"{d}/out")
    assert {r.id: r.exact_match for r in got.collect()} == {"1": 1.0, "2": 0.0} and got.count() == 2
    assert scoring.windowed_means(got, ["f1"]).count() == 2
    assert set(REGISTRY) >= {"exact_match", "f1", "wer", "cer", "bleu", "chrf", "mse"}


def test_command_line(spark, tmp_path, capsys):
    from scorewright.__main__ import main

    d = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "q", "expected": "x"}\n')
    spark.createDataFrame([("1", "x")], "id string, prediction string").write.parquet(f"{d}/p")
    main(["eval", "--kind", "freeform", "--data", f"{d}/a.jsonl", "--predictions", f"{d}/p", "--out", f"{d}/o"])
    main(["kinds"])
    assert spark.read.json(f"{d}/o/metrics").first().exact_match == 1.0 and "freeform" in capsys.readouterr().out
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "b.json").write_text('{"model": {"name": "o/b"}}')
    (tmp_path / "conf" / "a.yaml").write_text("{}")
    main(["models", f"{d}/conf"])
    main(["providers", f"{d}/conf", "--json"])
    assert capsys.readouterr().out.split("\n")[:3] == ["a", "b", '{"providers": ["a", "b"]}']
    (tmp_path / "tasks" / "g").mkdir(parents=True)
    (tmp_path / "tasks" / "g" / "metadata.json").write_text('{"subtasks": ["x", "y"]}')
    main(["tasks", f"{d}/tasks"])
    assert capsys.readouterr().out == "g\n  g.x\n  g.y\n"
    (tmp_path / "checks.jsonl").write_text('{"model": "m", "kind": "mode", "name": "chat", "tested": true, "ok": true}\n{"model": "n", "kind": "mode", "name": "chat", "tested": true, "ok": false}\n')
    main(["probe", f"{d}/checks.jsonl", "--out", f"{d}/probe"])
    assert {r.model: r.probe_status for r in spark.read.json(f"{d}/probe").collect()} == {"m": "passed", "n": "failed"} and capsys.readouterr().out == "failed 1\npassed 1\n"


class Refused(Exception):
    def __init__(self, code, said="no"):
        super().__init__(said)
        self.status_code = code


def test_retries():
    from scorewright.plans import retries

    assert [retries.decide(Refused(429), n) for n in (1, 2, 9)] == [(True, 5.0, "rate_limit"), (True, 15.0, "rate_limit"), (True, 120.0, "rate_limit")]
    assert retries.decide(Refused(404), 1) == (False, 0.0, "invalid_response") and retries.decide(Refused(404), 1, True)[0]
    assert [retries.decide(Refused(502), n)[1] for n in (1, 3, 9)] == [1.0, 4.0, 16.0] and retries.decide(ValueError("Rate limit"), 1)[2] == "rate_limit"
    waits, calls = [], iter([Refused(503), Refused(429), None])

    def call():
        error = next(calls)
        if error:
            raise error
        return "x"

    assert retries.attempted(call, 3, wait=waits.append) == ("x", None, None) and waits == [1.0, 15.0]
    assert retries.attempted(lambda: 1 / 0, 2, wait=waits.append)[2] == "connectivity_error" and len(waits) == 3


def test_groups_and_adapters(spark, tmp_path, monkeypatch):
    samples = spark.createDataFrame([("1", "q", "a")], "id string, text string, expected string")
    predict = tasks.from_table(spark.createDataFrame([("1", "a")], "id string, prediction string"))
    seen = []

    def task(name, shared):
        if name == "bad":
            raise RuntimeError("no data")
        return None if name == "odd" else tasks.ad_hoc("freeform", name)

    group = tasks.TaskGroup("g", task, subtasks=("one", "bad", "odd"), setup=lambda: seen.append("up") or 7, teardown=lambda x: seen.append(x), aggregate=lambda found: {n: e.metrics.first().exact_match for n, e in found.items()}, write_summary=lambda a, found: seen.append(a))
    out = tasks.run_group(group, lambda name: samples, predict)
    assert out.aggregated == {"one": 1.0} and out.skipped == ["odd"] and out.errors == {"bad": "RuntimeError: no data"} and seen == ["up", {"one": 1.0}, 7]
    own = tasks.run_group(tasks.TaskGroup("g", run=lambda name, shared: tasks.Evaluation(samples, samples)), lambda name: samples, predict, ["x"])
    assert list(own.subtasks) == ["x"]
    with pytest.raises(ValueError, match="either"):
        tasks.run_group(tasks.TaskGroup("g"), lambda name: samples, predict)
    (tmp_path / "plugs").mkdir()
    for name, body in {"__init__": "", "base": "", "_own": "", "echo": "class Adapter:\n    def __init__(self, model, options):\n        self.model, self.options = model, options\n"}.items():
        (tmp_path / "plugs" / f"{name}.py").write_text(body)
    monkeypatch.syspath_prepend(str(tmp_path))
    import plugs

    assert tasks.adapters(plugs) == ["echo"] and tasks.adapter(plugs, "echo", "m", {"a": 1}).options == {"a": 1}
    with pytest.raises(ValueError, match="there are echo"):
        tasks.adapter(plugs, "none", "m", {})


def test_summaries_and_outcomes(spark, tmp_path):
    from datetime import datetime

    inner = {"f1": 0.5, "ok": True, "n": "x", "total_samples": 4, "diagnostic_counts": {"plain": 3, "loop": 1}}
    assert config.summarized(inner) == {"f1": 0.5, "diagnostic_counts": {"plain": 3, "loop": 1}}
    assert config.summarized({"subtasks": {"a": inner}}, ["f1", "absent"])["subtasks"]["a"] == {"f1": 0.5, "diagnostic_counts": {"plain": 3, "loop": 1}}
    found = config.run_summary("m", "r", "now", {"g.a-b": {"f1": 0.1}}, {"g.a_b": config.summarized(inner), "x": {"subtasks": {"s": config.summarized(inner)}}})
    assert set(found["tasks"]) == {"g.a_b", "x"} and found["diagnostics"] == {"counts": {"plain": 6, "loop": 2}, "rates": {"plain": 0.75, "loop": 0.25}}
    records = {"a": {"status": "passed", "completed": True, "subtasks": {"s": {"status": "passed"}, "t": {}}}, "b": {"status": "degraded"}}
    out = config.run_outcome("m", "r", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1), records, "strict", found)
    assert (out["status"], out["exit_code"], out["duration_s"], out["counts"]["requested_subtasks"], out["counts"]["passed_subtasks"], out["counts"]["completed_tasks"]) == ("degraded", 1, 60.0, 2, 1, 1)
    assert config.run_outcome("m", "r", datetime(2024, 1, 1), datetime(2024, 1, 1), {"a": {}}, "smoke")["exit_code"] == 1
    sinks.write_group_summary(spark, str(tmp_path), "T", "o/m", "s", {"f1": 0.5}, {"a": {"f1": 0.25}})
    assert json.loads((tmp_path / "o_m_s_summary.json").read_text())["per_subtask_metrics"] == {"a": {"f1": 0.25}} and "f1: 0.2500" in (tmp_path / "o_m_s_summary.txt").read_text()
    assert sinks.performance_summary(10, 4.0)["throughput"] == 2.5 and sinks.performance_summary(0, 0.0)["throughput"] == 0.0
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "m.yaml").write_text("")
    assert config.model_config("o/m", str(tmp_path / "conf")).endswith("m.yaml") and config.model_config("none", str(tmp_path / "conf")) is None
    (tmp_path / "conf" / "z.json").write_text('{"model": {"name": "o/m"}}')
    assert config.model_config("o/m", str(tmp_path / "conf")).endswith("z.json")
    assert config.validate_task({"task_type": "classification", "dataset": {"name": "x", "labels": "[1]"}}) == ["labels must map values to texts"]


def test_more_sources(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "schema.json").write_text('{"properties": {}}')
    (tmp_path / "doc" / "expected.json").write_text('{"a.pdf": {"v": 1}, "b": {"v": 2}, "none": {"v": 3}}')
    for n in ("a.pdf", "b.png", "b.jpg"):
        (tmp_path / "doc" / n).write_bytes(b"1")
    got = {r.id: (r.expected, r.file_path.rsplit("/", 1)[-1]) for r in readers.read_expected(spark, f"{d}/doc").collect()}
    assert got == {"a": ('{"v":1}', "a.pdf"), "b": ('{"v":2}', "b.jpg")}
    (tmp_path / "r.json").write_text('[{"id": "x"}, {"id": "y"}]')
    (tmp_path / "ids.txt").write_text(" y \n\nz\n")
    assert [r.key for r in readers.read_json_records(spark, f"{d}/r.json", allowed=f"{d}/ids.txt").collect()] == ["y"]
    (tmp_path / "csvs").mkdir()
    (tmp_path / "csvs" / "test.tsv").write_text("\ufeffid\ttext\texpected\n1\tq\ta\n")
    assert [tuple(r) for r in readers.load_dataset(spark, readers.DatasetConfig(f"{d}/csvs")).select("id", "text", "expected").collect()] == [("1", "q", "a")]

    def fetch(spark, name, split):
        if split != "train":
            raise ValueError("no such split")
        return spark.createDataFrame([("1", "t", "e", 0)], "id string, text string, expected string, row_idx long")

    hub = readers.DatasetConfig("o/name", source="hub", fetch=fetch)
    assert readers.load_dataset(spark, hub).count() == 1
    with pytest.raises(ValueError, match="no such split"):
        readers.load_dataset(spark, readers.DatasetConfig("o/name", source="hub", split="dev", fetch=fetch))
    binary = spark.createDataFrame([("r1", bytearray(b"abc"))], "record_id string, data binary").withColumn("row_idx", F.lit(0))
    readers.materialize_binary(binary, "data", f"file://{d}/uri").collect()
    assert [p.name for p in (tmp_path / "uri").iterdir()] == ["r1.bin"]


def test_quantiles_and_ranks_of_hot_values(spark):
    import numpy as np

    rows = [(i % 3, float(i % 5 if i % 2 else 7)) for i in range(500)] + [(9, None), (None, 4.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (list(r.q) if r.q else None, r.n) for r in ranking.quantiles(df, "v", (0.1, 0.5, 0.9), ["g"]).collect()}
    for g in (0, 1, 2, None):
        values = [v for k, v in rows if k == g]
        assert got[g][0] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.9]).tolist()) and got[g][1] == len(values)
    assert got[9] == (None, 0) and ranking.quartiles(df.limit(0), "v").first().n == 0
    ranked = ranking.ranked(spark.createDataFrame([(f"{i:03}", float(i % 2)) for i in range(40)], "id string, v double"), "v", "id").collect()
    assert {r.id: r.rank_desc for r in ranked} == {f"{i:03}": n + 1 for n, i in enumerate(sorted(range(40), key=lambda i: (-(i % 2), i)))}
    assert sorted(r.rank_asc for r in ranked) == list(range(1, 41))


def test_ranks_over_sampled_ranges(many_ranges):
    """F4, rank_percentile: few values, many ids."""
    rows = [(i, float(i * 31 % 7)) for i in range(5000)]
    got = ranking.ranked(many_ranges.createDataFrame(rows, "id long, v double").repartition(6), "v", "id").collect()
    up = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], str(r[0]))), 1)}
    down = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], str(r[0]))), 1)}
    assert {r.id: (r.rank_asc, r.rank_desc, r.percentile) for r in got} == {i: (up[i], down[i], (up[i] - 1) / 4999) for i in up} and len(got) == 5000


# BLEU and chrF in plain Python, over the table that the queries use


def plain_13a(x):
    import re

    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = x.replace(a, b)
    x = f" {x} "
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = re.sub(a, b, x)
    return re.split(r"[ \t\n\x0b\f\r]+", x.strip(" \t\n\x0b\f\r")) if x.strip() else []


def plain_grams(items, n):
    from collections import Counter

    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def plain_bleu(pairs, effective):
    import math

    match, total, p_len, r_len = [0] * 4, [0] * 4, 0, 0
    for p, e in pairs:
        a, b = plain_13a(p), plain_13a(e)
        p_len, r_len = p_len + len(a), r_len + len(b)
        for n in range(4):
            x = plain_grams(a, n + 1)
            match[n] += sum((x & plain_grams(b, n + 1)).values())
            total[n] += sum(x.values())
    if not match[0] or (not effective and 0 in total):
        return 0.0
    smooth, logs = 1.0, []
    for m, k in zip(match, total, strict=True):
        if k:
            smooth *= 1 if m else 2
            logs.append(math.log(m / k if m else 1 / (smooth * k)))
    return (math.exp(1 - r_len / p_len) if p_len < r_len else 1.0) * math.exp(sum(logs) / (len(logs) if effective else 4))


def plain_chrf(pairs):
    sums = [[0, 0, 0] for _ in range(6)]
    for p, e in pairs:
        a, b = ("".join(x.split(None)) for x in (p, e))
        for n, s in enumerate(sums, 1):
            x, y = plain_grams(a, n), plain_grams(b, n)
            for i, v in enumerate((sum((x & y).values()), sum(x.values()), sum(y.values()))):
                s[i] += v
    used = [(m / a, m / b) for m, a, b in sums if a and b]
    if not used:
        return 0.0
    p, r = (sum(x) / len(used) for x in zip(*used, strict=True))
    return 5 * p * r / (4 * p + r) if p + r else 0.0


def test_bleu_and_chrf_over_the_table(spark):
    from collections import defaultdict

    from scorewright.plans import catalog

    pairs = {(r.conv_id, r.turn): (r.role, r.prediction, r.expected) for r in catalog.turn_pairs(spark, "/root/testdata/sf0.001").collect()}
    for r in catalog.QUERIES["sentence_bleu_chrf"](spark, "/root/testdata/sf0.001").collect():
        _, p, e = pairs[r.conv_id, r.turn]
        assert (r.bleu, r.chrf) == (pytest.approx(plain_bleu([(p, e)], True), abs=2e-6), pytest.approx(plain_chrf([(p, e)]), abs=2e-6))
    by = defaultdict(list)
    for role, p, e in pairs.values():
        by[role].append((p, e))
    got = {r.role: (r.bleu, r.chrf) for r in catalog.QUERIES["corpus_bleu_chrf"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {role: (pytest.approx(plain_bleu(x, False), abs=2e-6), pytest.approx(plain_chrf(x), abs=2e-6)) for role, x in by.items()}
