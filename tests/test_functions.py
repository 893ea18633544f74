"""Row functions on literals and edge cases, and against small plain versions."""

import json
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.functions import choice, jsons, media, metrics, similarity, text


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


L = F.lit


def test_exact_match_and_f1(spark):
    row = one(spark, metrics.exact_match(L(" Ab "), L("aB")), metrics.exact_match(L(None), L("a")), metrics.token_f1(L("the quick brown dog"), L("the quick brown fox")), metrics.token_f1(L(""), L("a")), metrics.token_f1_best(L("a b"), F.array(L("c"), L("a b"))))
    assert tuple(row) == (1.0, 0.0, 0.75, 0.0, 1.0)


def plain_f1(p, e):
    a, b = p.lower().split(), e.lower().split()
    k = sum((Counter(a) & Counter(b)).values())
    return 2 * k / (len(a) + len(b)) if k else 0.0


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_f1_wer_cer_against_plain(spark):
    pairs = [("a a b", "a b b c"), ("one two", "one"), ("É x", "é x y"), ("a", ""), ("", ""), ("w " * 300, "w " * 299 + "v"), (" ".join(map(str, range(300))), " ".join(map(str, range(1, 301))))]
    rows = spark.createDataFrame(pairs, "p string, e string").select("p", "e", metrics.token_f1("p", "e").alias("f"), metrics.word_error_rate("p", "e").alias("w"), metrics.character_error_rate("p", "e").alias("c")).collect()
    for r in rows:
        assert r.f == pytest.approx(plain_f1(r.p, r.e))
        a, b = r.p.split(), r.e.split()
        assert r.w == pytest.approx(plain_edits(a, b) / len(b) if a and b else 1.0)
        assert r.c == pytest.approx(plain_edits(r.p.strip(), r.e.strip()) / len(r.e.strip()) if a and b else 1.0)


def test_bleu_and_chrf(spark):
    row = one(spark, metrics.sentence_bleu(L("the cat sat on the mat"), L("the cat sat on the mat")), metrics.sentence_bleu(L("x"), L("y")), metrics.sentence_chrf(L("abc def"), L("abc def")), metrics.sentence_chrf(L("a"), L("b")), metrics.sentence_bleu(L("the cat is on the mat"), L("the cat sat on the mat")))
    assert row[0] == pytest.approx(1) and row[1] == 0 and row[2] == pytest.approx(1) and row[3] == 0
    # 5/6, 3/5, 1/4, and no 4-gram of 3: half of one of them.
    assert row[4] == pytest.approx(math.exp(sum(map(math.log, (5 / 6, 3 / 5, 1 / 4, 1 / 6))) / 4))
    tokens = one(spark, metrics.tokenize_13a(L('Hi, "you" 3.5% a-b &amp; 2-3.')))[0]
    assert tokens == ["Hi", ",", '"', "you", '"', "3.5", "%", "a-b", "&", "2", "-", "3", "."]


def test_corpus_bleu_sums_before_it_divides(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e"), ("v w x y z", "q r s t u")], "p string, e string")
    got = metrics.corpus_bleu(df, "p", "e").first().bleu
    assert got == pytest.approx(0.5)
    assert metrics.corpus_chrf(df, "p", "e").first().chrf == pytest.approx(0.5)


def test_regression_aggregates(spark):
    assert one(spark, metrics.squared_error(L("3.0"), L("5.0")))[0] == 4.0
    df = spark.createDataFrame([(4.0, 1.0, 1.0), (9.0, 2.0, 2.0), (1.0, 3.0, 3.0), (float("nan"), 9.0, None), (None, float("nan"), 1.0)], "m double, p double, e double")
    row = df.agg(metrics.mean_or("m").alias("mean"), metrics.pearson("p", "e").alias("r")).first()
    assert row["mean"] == pytest.approx(14 / 3) and row["r"] == pytest.approx(1.0)
    one_pair, flat = df.limit(1), df.withColumn("e", L(1.0))
    assert one_pair.agg(metrics.pearson("p", "e")).first()[0] == 0.0 == flat.agg(metrics.pearson("p", "e")).first()[0]
    assert df.limit(0).agg(metrics.REGISTRY["wer"].aggregate("m")).first()[0] == 1.0


def test_text_functions(spark):
    row = one(
        spark, text.strip(L(" \x1c a b\x85 ")), text.collapse(L(" a \n\t b ")), text.nfkd(L("ﬁ Córdoba")), text.fold_latin(L("Córdoba ñ ß e\u0301")), text.digits_only(L("a1-٢3")), text.shorten(L("abcdef"), 5),
        text.answer_segment(L("Answer: x\nrespuesta: B) ok")), text.answer_segment(L("  none ")), text.last_float(L("a 1,5 b -2.5c")), text.last_float(L("x"), fallback=3), text.last_float(L("9"), 1, 5),
        text.whitespace_run(L("a  \n b")), text.repetition(L("x " * 20)), text.repetition(L("a b c")), text.repetition(L("a" + " " * 80 + "b")), text.bigram_repetition(L("a b " * 10)), text.looks_like_markup(L("<TD x")),
        text.cause_effect(L("Llueve."), L("El suelo"), L("effect")), text.paraphrase_side(L("a  b .")), text.without_bracket_marks(L("x [1] y")), text.comma_decimal(L(1.25), 2), text.format_choices(F.array(L("p"), L("q")), F.array(L("A"), L("B"))),
    )
    assert tuple(row) == ("a b", "a b", "fi Cordoba", "Cordoba n ß e", "1٢3", "ab...", "B) ok", "none", -2.5, 3.0, 5.0, 4, True, False, True, True, True, "Llueve y por lo tanto el suelo", "a b ", "x  y", "1,25", "A. p\nB. q")
    with pytest.raises(KeyError):
        text.fill_template("{absent}")


def test_choices(spark):
    choices, labels = F.array(L("Perro grande"), L("Gato"), L("Café con leche caliente")), F.array(L("A"), L("B"), L("C"))
    said = ['{"answer": "B"}', "2", "7", "b)", "The answer: GATO", "cafe con leche caliente!", "1.0", "[\"C\"]", '{"x": {"label": "A"}}', "", None, "nothing", "respuesta: A\nanswer: C"]
    want = [1, 2, None, 1, 1, 2, 1, 2, 0, None, None, None, 2]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", choice.choice_prediction("s", choices, labels).alias("c")).collect()}
    assert [got[i] for i in range(len(said))] == want
    row = one(spark, choice.choice_index(L("7"), choices, labels, F.create_map(L("7"), L(1))), choice.choice_index(L("x cafe con l"), choices, labels), choice.choice_index(L("x café con l y"), choices, labels, strict=False), choice.choice_label(L("(b) or a"), labels))
    assert tuple(row) == (1, None, 2, "A")


def test_similarity(spark):
    row = one(spark, similarity.edit_similarity(L("café"), L("cafe")), similarity.containment(L("ab"), L("abcd")), similarity.containment(L("abcd"), L("ab")), similarity.token_set_f1(L("a a b"), L("a")), similarity.compare_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).match_type, similarity.compare_numbers(L(1000.5), L(1000.0)).match_type, similarity.compare_numbers(L(1000.5), L(1000.0), similarity.STRICT).match_type)
    assert tuple(row) == (0.75, 0.5, 1.0, pytest.approx(2 / 3), "exact", "exact", "incorrect")
    cases = [("null", None, "null", None, "exact", "none"), ("null", None, "string", "a", "incorrect", "critical"), ("string", "a b", "string", "a b", "exact", "none"), ("string", "zzz", "string", "a b", "incorrect", "minor"), ("number", "1", "boolean", "true", "exact", "none"), ("number", "2", "number", "1", "incorrect", "critical"), ("string", "1", "number", "1", "incorrect", "critical"), ("array", '["a","b"]', "array", '["b"]', "partial", "minor")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, pk string, p string, ek string, e string, m string, s string")
    c = similarity.compare_typed(F.col("p"), F.col("pk"), F.col("e"), F.col("ek"), F.col("p"), F.col("e"))
    assert all(r.m == r.c.match_type and r.s == r.c.severity for r in df.select("m", "s", c.alias("c")).collect())


def test_json_functions(spark):
    row = one(spark, jsons.json_candidate(L('x ```json\n{"a":1}\n``` y')), jsons.json_candidate(L('so {"a":{"b":1}} ok')), jsons.json_candidate(L("{ {")), jsons.json_path(L('{"a":[{"b":"c"}]}'), "a.0.b"), jsons.iso_date(L("15/01/2024")), jsons.iso_date(L("31-02-2024")), jsons.padded_time(L("9:05")), jsons.padded_time(L("24:00")), jsons.null_penalty(L(20)), media.decode_base64(L("data:image/png;base64,aGVsbG8")))
    assert tuple(row) == ('{"a":1}', '{"a":{"b":1}}', "{ {", "c", "2024-01-15", "31-02-2024", "09:05", "24:00", 0.2, b"hello")
    assert jsons.flat({"a": {"b": [1, {"c": None}, [2]], "d": {}, "e": []}}) == {"a.b[0]": 1, "a.b[1].c": None, "a.b[2]": [2]}
    assert jsons.flat([1]) == {"root": [1]}
    assert jsons.fingerprint({"a": 1, "b": 2}) == jsons.fingerprint({"b": 2, "a": 1})
    schema = {"type": "object", "properties": {"d": {"$ref": "#/$defs/day"}, "n": {"type": ["integer", "null"]}}, "$defs": {"day": {"type": "string", "format": "date"}}}
    found = []
    assert jsons.normalized({"d": "15-01-2024", "n": "null", "t": "9:30", "x": "15-01-2024"}, schema, True, "", found) == {"d": "2024-01-15", "n": None, "t": "09:30", "x": "15-01-2024"} and found == ["date", "null"]
    assert jsons.equal_values({"a": 1, "b": " x"}, {"a": 1.0, "b": "X "}) and not jsons.equal_values({"a": 1}, {"a": 1, "b": 2})
    assert jsons.complexity(schema)["total_fields"] == 2
    strict = jsons.sanitize_schema({"json_schema": {"schema": schema}})
    assert strict["additionalProperties"] is False and strict["required"] == ["d", "n"] and strict["properties"]["d"] == {"type": "string"}
    plain, columns, types = jsons.plain_schema({"fields": [{"name": "a", "type": "integer", "required": True, "gt_field": "col_a"}]})
    assert plain["required"] == ["a"] and columns == {"col_a": "a"} and types == {"a": "integer"}


def test_request_bodies(spark):
    template = {"q": "say {{t}}!", "n": "{{n}}", "raw": "{{t|str}}", "j": "{{t|json}}", "b": "{{t|base64}}", "l": [1, None, "{{z}}"]}
    body = one(spark, jsons.render_body(template, t=L('a"b'), n=L(3), z=L(None).cast("string")))[0]
    assert json.loads(body) == {"q": 'say a"b!', "n": 3, "raw": 'a"b', "j": '"a\\"b"', "b": "YSJi", "l": [1, None, None]}
    with pytest.raises(KeyError):
        jsons.render_body("{{absent}}")


@pytest.mark.parametrize(
    ("value", "schema", "ok"),
    [
        (1, {"type": "integer"}, True), (1.0, {"type": "integer"}, True), (True, {"type": "integer"}, False), ("a", {"enum": ["a"]}, True), ({"a": 1}, {"required": ["b"]}, False), ({"a": 1}, {"properties": {}, "additionalProperties": False}, False),
        ([1, "a"], {"items": {"type": "integer"}}, False), ("ab", {"pattern": "^a"}, True), (5, {"minimum": 6}, False), (5, {"anyOf": [{"type": "string"}, {"minimum": 5}]}, True), (5, {"oneOf": [{"minimum": 1}, {"minimum": 5}]}, False), (5, {"allOf": [{"maximum": 5}]}, True), (5, {"not": {"type": "integer"}}, False), (None, {"type": "null"}, True),
    ],
)
def test_validator(value, schema, ok):
    assert jsons.valid(value, schema) is ok


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab.", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("xy", min_size=1, max_size=2), x, max_size=3), max_leaves=8))
def test_flatten_keeps_every_leaf(value):
    def leaves(v, inside_list=False):
        if isinstance(v, dict):
            return sum(leaves(x) for x in v.values())
        if isinstance(v, list) and not inside_list:
            return sum(leaves(x, True) for x in v)
        return 1

    if isinstance(value, dict):
        assert len(jsons.flat(value)) == leaves(value)
    else:
        assert jsons.flat(value) == {"root": value}
    json.dumps(jsons.flat(value))
