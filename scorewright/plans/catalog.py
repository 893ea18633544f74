"""Registered queries on the fixture tables, each with independent SQL where SQL can express it.

Fixtures hold no model outputs, so predictions and expectations are derived from their columns in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import choice, images, jsons, media, metrics, similarity, text
from ..operators import aggregates, joins, leaderboard, mapping, ranking, resume, status, structured
from ..sources import readers, sinks
from ..sources.folders import new_folder
from . import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(x: Column | str, name: str) -> Column:
    return F.round(text.col(x), 6).alias(name)


def long(x: Column, name: str) -> Column:
    return x.cast("long").alias(name)


# Row metrics


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the next one's text as its prediction; every third turn is echoed with blanks around it."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("expected"))
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("expected").alias("next_text"))
    met = c.join(following, ["conv_id", "turn"])
    return met.withColumn("prediction", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.col("expected"), F.lit(" "))).otherwise(F.col("next_text")))


@query("""
WITH p AS (SELECT c.conv_id, c.turn, c.role, c.text AS expected, CASE WHEN c.turn % 3 = 0 THEN '  ' || c.text || ' ' ELSE n.text END AS prediction
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)
SELECT role, count(*) AS n, round(avg(CASE WHEN lower(trim(prediction)) = lower(trim(expected)) THEN 1.0 ELSE 0.0 END), 6) AS exact_match,
  round(avg(CASE WHEN prediction = expected THEN 1.0 ELSE 0.0 END), 6) AS raw_match FROM p GROUP BY role""")
def exact_match_by_role(spark, d):
    p = turn_pairs(spark, d)
    scored = p.withColumns({"em": metrics.exact_match("prediction", "expected"), "raw": metrics.exact_match("prediction", "expected", False, False)})
    return scored.groupBy("role").agg(F.count("*").alias("n"), r6(metrics.mean_or("em"), "exact_match"), r6(metrics.mean_or("raw"), "raw_match"))


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("expected"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("expected").alias("prediction")), "p_partkey")


NAMES = "SELECT a.p_partkey, a.p_name AS e, b.p_name AS p FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query(f"""
WITH n AS ({NAMES}), pt AS (SELECT p_partkey, w, count(*) AS c FROM (SELECT p_partkey, unnest(string_split(lower(p), ' ')) AS w FROM n) GROUP BY ALL),
et AS (SELECT p_partkey, w, count(*) AS c FROM (SELECT p_partkey, unnest(string_split(lower(e), ' ')) AS w FROM n) GROUP BY ALL),
o AS (SELECT p_partkey, sum(least(pt.c, et.c)) AS k FROM pt JOIN et USING (p_partkey, w) GROUP BY p_partkey),
s AS (SELECT p_partkey, coalesce(k, 0) / len(string_split(p, ' ')) AS pr, coalesce(k, 0) / len(string_split(e, ' ')) AS rc FROM n LEFT JOIN o USING (p_partkey))
SELECT p_partkey, round(CASE WHEN pr + rc > 0 THEN 2.0 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM s""")
def token_f1(spark, d):
    return name_pairs(spark, d).select("p_partkey", r6(metrics.token_f1("prediction", "expected"), "f1"))


@query(f"""
WITH n AS ({NAMES})
SELECT p_partkey, round(levenshtein(p, e)::DOUBLE / length(e), 6) AS cer,
  CASE WHEN p = e THEN 0.0 WHEN len(string_split(p, ' ')) = 2 AND len(string_split(e, ' ')) = 2 THEN CASE
    WHEN string_split(p, ' ')[1] = string_split(e, ' ')[1] OR string_split(p, ' ')[2] = string_split(e, ' ')[2] THEN 0.5 ELSE 1.0 END END AS wer,
  round(greatest(0.0, 1 - CASE WHEN p = e THEN 0.0 WHEN string_split(p, ' ')[1] = string_split(e, ' ')[1] OR string_split(p, ' ')[2] = string_split(e, ' ')[2] THEN 0.5 ELSE 1.0 END), 4) AS word_accuracy FROM n""")
def wer_cer(spark, d):
    wer = metrics.word_error_rate("prediction", "expected")
    return name_pairs(spark, d).select("p_partkey", r6(metrics.character_error_rate("prediction", "expected"), "cer"), wer.alias("wer"), aggregates.word_accuracy(wer).alias("word_accuracy"))


@query()
def sentence_bleu_chrf(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", r6(metrics.sentence_bleu("prediction", "expected"), "bleu"), r6(metrics.sentence_chrf("prediction", "expected"), "chrf"))


@query()
def corpus_bleu_chrf(spark, d):
    p = turn_pairs(spark, d)
    b, c = metrics.corpus_bleu(p, "prediction", "expected", ["role"]), metrics.corpus_chrf(p, "prediction", "expected", ["role"])
    return b.join(c, "role").select("role", r6("bleu", "bleu"), r6("chrf", "chrf"))


@query("""
SELECT l_returnflag, round(avg(power(l_quantity - l_extendedprice, 2)), 4) AS mse, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS pearson, 0.0 AS flat, count(*) AS total_samples
FROM lineitem GROUP BY l_returnflag""")
def mse_pearson(spark, d):
    li = t(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    whole = aggregates.regression(li, "l_quantity", "l_extendedprice", ["l_returnflag"])
    flat = li.groupBy("l_returnflag").agg(metrics.pearson("l_quantity", "one").alias("flat"))
    return whole.join(flat, "l_returnflag").select("l_returnflag", F.round("mse", 4).alias("mse"), r6("pearson", "pearson"), "flat", "total_samples")


# Text functions


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\s]+', ' ', 'g'))) AS answer, md5(trim(regexp_replace(strip_accents(lower(text)), '[\s]+', ' ', 'g'))) AS folded,
  md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS choice FROM documents""")
def normalize_text(spark, d):
    x = t(spark, d, "documents")
    md5 = lambda c, n: F.md5(c.cast("binary")).alias(n)
    return x.select("doc_id", md5(text.normalize_answer("text"), "answer"), md5(text.normalize_text("text", latin_only=True), "folded"), md5(text.normalize_choice("text", latin_only=True), "choice"))


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def accent_fold(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.nfkd("text").cast("binary")).alias("folded"))


@query(r"""
SELECT o_orderkey, regexp_replace(replace(replace('Av. ' || o_orderpriority || ' St', 'Av.', 'avenue'), 'St', 'street'), '^.*$', '') || array_to_string(list_sort(string_split(lower('avenue ' || o_orderpriority || ' street'), ' ')), ' ') AS name,
  regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS digits, CASE WHEN length(o_orderpriority) > 6 THEN left(o_orderpriority, 3) || '...' ELSE o_orderpriority END AS short, replace(printf('%.2f', o_totalprice), '.', ',') AS comma FROM orders""")
def text_cleanup(spark, d):
    o = t(spark, d, "orders")
    name = text.normalize_freeform(F.concat(F.lit("Av. "), F.col("o_orderpriority"), F.lit(" St")), {"av.": "avenue", "st": "street"}, sort_words=True, latin_only=True)
    return o.select("o_orderkey", name.alias("name"), text.digits_only("o_orderpriority").alias("digits"), text.shorten("o_orderpriority", 6).alias("short"), text.comma_decimal("o_totalprice", 2).alias("comma"))


@query("""
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)[^0-9]*$', 1) AS DOUBLE) AS number, least(5.0, CAST(regexp_extract(props, '([0-9]+)[^0-9]*$', 1) AS DOUBLE)) AS clipped, -1.0 AS fallback FROM events""")
def last_number(spark, d):
    return t(spark, d, "events").select("event_id", text.last_float("props").alias("number"), text.last_float("props", 0, 5).alias("clipped"), text.last_float(F.lit("none"), fallback=-1).alias("fallback"))


@query("SELECT o_orderkey, trim(o_orderstatus) AS segment, trim(o_orderpriority) AS plain FROM orders")
def answer_segment(spark, d):
    said = F.concat(F.lit("The answer: maybe.\nRespuesta: "), F.col("o_orderpriority"), F.lit("\nfinal label: "), F.col("o_orderstatus"), F.lit(" "))
    return t(spark, d, "orders").select("o_orderkey", text.answer_segment(said).alias("segment"), text.answer_segment(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("plain"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN 0 END AS verdict FROM orders")
def yes_no(spark, d):
    said = F.when(F.col("o_orderstatus") == "O", "assim? Sim, nao").when(F.col("o_orderstatus") == "F", "anao").otherwise("talvez")
    return t(spark, d, "orders").select("o_orderkey", text.yes_no(said, {"sim": 1, "nao": 0}).alias("verdict"))


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS by_text, o_orderkey % 5 AS by_number,
  ascii(substr('ABCDE', 1 + CAST(o_orderkey % 5 AS INT), 1)) - 65 AS by_letter, 'A. one' || chr(10) || 'B. two' AS listed FROM orders""")
def choice_parse(spark, d):
    o = t(spark, d, "orders").withColumns({"choices": F.array(*map(F.lit, ("Urgent", "High", "Medium", "Not specified", "Low"))), "labels": F.array(*map(F.lit, "ABCDE"))})
    k = F.col("o_orderkey") % 5
    letter = F.substring(F.lit("ABCDE"), (k + 1).cast("int"), F.lit(1))
    parse = lambda x: choice.choice_prediction(x, "choices", "labels")
    return o.select("o_orderkey", parse(F.col("o_orderpriority")).alias("by_text"), long(parse(F.concat(F.lit('{"label": '), k.cast("string"), F.lit("}"))), "by_number"),
                    parse(F.concat(F.lit("I think.\nAnswer: ("), F.lower(letter), F.lit(")"))).alias("by_letter"), text.format_choices(F.array(F.lit("one"), F.lit("two")), "labels").alias("listed"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN l_discount >= l_tax THEN 'A' ELSE 'B' END AS choice FROM lineitem")
def logprob_choice(spark, d):
    logs = F.create_map(F.lit(" A"), F.col("l_discount"), F.lit("\nB)"), F.col("l_tax"), F.lit("C"), F.lit(float("-inf")))
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", choice.logprob_choice(logs, ["A", "B", "C"]).alias("choice"))


@query(r"""
SELECT page_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(html, '[ \n\r\t]+'), lambda x: length(x))), 0) AS BIGINT) AS run, regexp_matches(html, '(?i)<(table|tr|td|th|html|body|div|span)\b') AS markup FROM pages""")
def whitespace_markup(spark, d):
    return t(spark, d, "pages").select("page_id", long(text.whitespace_run("html"), "run"), text.looks_like_markup("html").alias("markup"))


@query(r"""
WITH w AS (SELECT doc_id, text, string_split(trim(regexp_replace(text, '[\s]+', ' ', 'g')), ' ') AS ws FROM documents),
k AS (SELECT doc_id, CASE WHEN text = '' THEN 'not_applicable' WHEN regexp_matches(text, '(?i)<(table|tr|td|th|html|body|div|span)\b') THEN 'ocr_text_or_markup'
  WHEN regexp_matches(text, '[\s]{80,}') OR (len(ws) >= 18 AND len(list_filter(range(1, len(ws) - 14), lambda i: (ws[i] = ws[i+1] AND ws[i] = ws[i+2]) OR len(list_filter(ws[i:i+14], lambda x: x = ws[i])) >= 6)) > 0) THEN 'degenerate_repetition'
  ELSE 'plain_text' END AS diagnostic_class FROM w)
SELECT diagnostic_class, count(*) AS count, sum(count(*)) OVER ()::BIGINT AS run_samples, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM k GROUP BY diagnostic_class""")
def diagnostic_classes(spark, d):
    x = t(spark, d, "documents").withColumn("diagnostic_class", status.generic_class("text"))
    return aggregates.class_rates(x).select("diagnostic_class", "count", "run_samples", r6("rate", "rate"))


@query("""
SELECT c_custkey, 'Q: ' || c_name || ' {x} in ' || c_mktsegment AS prompt, left(c_name, 5) AS head, split_part('org/' || c_name, '/', 2) AS model, 'org' AS publisher, 'es.' || replace(c_mktsegment || '-a-b', '-', '_') AS task_key FROM customer""")
def projections(spark, d):
    c = t(spark, d, "customer")
    model = F.concat(F.lit("org/"), F.col("c_name"))
    return c.select("c_custkey", text.fill_template("Q: {name} {{x}} in {seg}", name="c_name", seg="c_mktsegment").alias("prompt"), text.truncate("c_name", 5).alias("head"), leaderboard.short_name(model).alias("model"),
                    leaderboard.publisher(model).alias("publisher"), joins.canonical_key(F.concat(F.lit("es."), F.col("c_mktsegment"), F.lit("-a-b"))).alias("task_key"))


# Likeness

_COMPOSITE = """
SELECT p_partkey, p, e, len(list_intersect(list_distinct(string_split(p, ' ')), list_distinct(string_split(e, ' '))))::DOUBLE AS k, len(list_distinct(string_split(p, ' '))) AS np, len(list_distinct(string_split(e, ' '))) AS ne,
  1 - levenshtein(p, e)::DOUBLE / greatest(length(p), length(e)) AS lev, CASE WHEN contains(p, e) THEN 1.0 WHEN contains(e, p) THEN length(p)::DOUBLE / length(e) ELSE 0.0 END AS cont FROM n"""
_SCORED = f"WITH n AS ({NAMES}), c AS ({_COMPOSITE}), s AS (SELECT *, CASE WHEN k > 0 THEN 2.0 * k / (np + ne) ELSE 0.0 END AS tf FROM c), z AS (SELECT *, CASE WHEN p = e THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * tf + 0.3::DOUBLE * lev + 0.2::DOUBLE * cont END AS score FROM s)"


@query(f"""{_SCORED}
SELECT p_partkey, round(tf, 6) AS token_f1, round(lev, 6) AS edit, round(cont, 6) AS containment, round(score, 6) AS score, CASE WHEN p = e OR score >= 0.95 THEN 'exact' WHEN score >= 0.5 THEN 'partial' ELSE 'incorrect' END AS match_type FROM z""")
def composite_string_match(spark, d):
    c = similarity.compare_strings("prediction", "expected")
    return name_pairs(spark, d).select("p_partkey", r6(similarity.token_set_f1("prediction", "expected"), "token_f1"), r6(similarity.edit_similarity("prediction", "expected"), "edit"),
                                       r6(similarity.containment("prediction", "expected"), "containment"), r6(c.score, "score"), c.match_type.alias("match_type"))


@query("""
SELECT o_orderkey, CASE WHEN abs(round(o_totalprice, 0) - o_totalprice) <= 1e-6 + 1e-3 * abs(o_totalprice) THEN 'exact' ELSE 'incorrect' END AS usual,
  CASE WHEN abs(round(o_totalprice, 0) - o_totalprice) <= 1e-9 + 1e-4 * abs(o_totalprice) THEN 'exact' ELSE 'incorrect' END AS strict FROM orders""")
def numeric_match(spark, d):
    o = t(spark, d, "orders").withColumn("p", F.round("o_totalprice", 0))
    return o.select("o_orderkey", similarity.compare_numbers("p", "o_totalprice").match_type.alias("usual"), similarity.compare_numbers("p", "o_totalprice", similarity.STRICT).match_type.alias("strict"))


@query("""
WITH a AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS e, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O')) AS p FROM orders GROUP BY o_custkey),
s AS (SELECT o_custkey, len(list_intersect(coalesce(p, []), e))::DOUBLE / len(list_distinct(list_concat(coalesce(p, []), e))) AS score FROM a)
SELECT o_custkey, round(score, 6) AS score, CASE WHEN score = 1 THEN 'exact' WHEN score >= 0.5 THEN 'partial' ELSE 'incorrect' END AS match_type FROM s""")
def array_jaccard(spark, d):
    a = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("e"), F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("p"))
    c = similarity.compare_arrays("p", "e")
    return a.select("o_custkey", r6(c.score, "score"), c.match_type.alias("match_type"))


# JSON, dates, hashes


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent, true AS ok, '{"a": ' || (event_id % 7) || '}' AS candidate, left(sha1(props), 12) AS fingerprint, md5(props) AS hash FROM events""")
def json_functions(spark, d):
    e = t(spark, d, "events")
    wrapped = F.concat(F.when(F.col("event_id") % 2 == 0, "```json\n").otherwise("so "), F.lit('{"a": '), (F.col("event_id") % 7).cast("string"), F.lit("}"), F.when(F.col("event_id") % 2 == 0, "\n``` ok").otherwise(" then"))
    return e.select("event_id", jsons.json_path("props", "k").alias("k"), jsons.json_path("props", "absent").alias("absent"), jsons.json_ok("props").alias("ok"), jsons.json_candidate(wrapped).alias("candidate"),
                    F.left(F.sha1("props"), F.lit(12)).alias("fingerprint"), F.md5("props").alias("hash"))


@query("""
SELECT c_custkey, 'name' AS field, c_name AS value, 'string' AS kind FROM customer UNION ALL SELECT c_custkey, 'where.nation', CAST(c_nationkey AS VARCHAR), 'number' FROM customer
UNION ALL SELECT c_custkey, 'tags[0]', c_mktsegment, 'string' FROM customer UNION ALL SELECT c_custkey, 'tags[1]', NULL, 'null' FROM customer UNION ALL SELECT c_custkey, 'rows[0].ok', 'true', 'boolean' FROM customer""")
def json_flatten(spark, d):
    c = t(spark, d, "customer")
    body = F.format_string('{"name": "%s", "where": {"nation": %d, "none": {}}, "tags": ["%s", null], "rows": [{"ok": true}], "empty": []}', "c_name", "c_nationkey", "c_mktsegment")
    return structured.flattened(c.select("c_custkey", body.alias("body")), "c_custkey", "body").select(F.col("sample_id").alias("c_custkey"), "field", "value", "kind")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dashed, strftime(o_orderdate, '%Y-%m-%d') AS slashed, '31-02-2020' AS no_day, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':05' AS at, '25:00' AS no_time,
  strftime(o_orderdate, '%Y-%m-%d') AS padded, strftime(o_orderdate, '%Y-%m-%d') AS iso, '09:05' AS padded_at, ' 31-02-2020 ' AS padded_no_day FROM orders""")
def date_canonicalize(spark, d):
    o = t(spark, d, "orders")
    f = lambda p: jsons.iso_date(F.date_format("o_orderdate", p))
    return o.select("o_orderkey", f("dd-MM-yyyy").alias("dashed"), f("dd/MM/yyyy").alias("slashed"), jsons.iso_date(F.lit("31-02-2020")).alias("no_day"),
                    jsons.padded_time(F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":05"))).alias("at"), jsons.padded_time(F.lit("25:00")).alias("no_time"),
                    f("' 'dd-MM-yyyy'  '").alias("padded"), f("' 'yyyy-MM-dd").alias("iso"), jsons.padded_time(F.lit(" 9:05\t")).alias("padded_at"), jsons.iso_date(F.lit(" 31-02-2020 ")).alias("padded_no_day"))


_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 3}}}


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT) >= 3, false) AS valid, true AS open, false AS closed FROM events")
def json_validate(spark, d):
    return t(spark, d, "events").select("event_id", jsons.validate_json(_SCHEMA)("props").alias("valid"), jsons.validate_json({})("props").alias("open"), jsons.validate_json({}, False)("props").alias("closed"))


# Mapping


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS text, CASE WHEN c_custkey % 4 = 0 THEN '{"who":{}}' ELSE '{"who":{"segment":"' || c_mktsegment || '"}}' END AS stub,
  '{"who":{' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '"segment":"' || c_mktsegment || '",' END || '"nation":' || c_nationkey || '}}' AS expected FROM customer WHERE c_custkey % 5 <> 0""")
def ground_truth(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("gt_segment"), F.col("c_nationkey").cast("double").alias("gt_nation"))
    stub = mapping.ground_truth(c, {"gt_segment": "who.segment"})
    fields = mapping.FieldMap(id="key", text="name", ground_truth={"gt_segment": "who.segment", "gt_nation": "who.nation"}, types={"who.nation": "integer"})
    return mapping.normalize_samples(c.withColumn("stub", stub), fields).select("id", "text", "stub", "expected")


@query("SELECT quality AS expected, count(*) AS n, min(doc_id) AS first_doc FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def label_lookup(spark, d):
    met = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id"), "doc_id")
    return mapping.labelled_choices(met, "quality", {"0": "No", "1": "Yes"}).groupBy("expected").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT printf('sample_%06d', row_number() OVER (ORDER BY o_orderkey) - 1) AS id, o_orderpriority AS text, o_orderstatus AS expected FROM orders")
def generated_ids(spark, d):
    o = mapping.numbered(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderkey"])
    return mapping.normalize_samples(o, mapping.FieldMap(text="o_orderpriority", expected="o_orderstatus")).select("id", "text", "expected")


@query("""
SELECT c_custkey, CAST(coalesce(list_position(['AUTOMOBILE', 'BUILDING', 'MACHINERY'], c_mktsegment), 1) - 1 AS INT) AS answer, lower(left(c_name, 1)) || substr(c_name, 2) || '' AS small FROM customer""")
def exam_answers(spark, d):
    labels = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "MACHINERY")))
    return t(spark, d, "customer").select("c_custkey", text.answer_key_index(F.lower("c_mktsegment"), labels, 0).alias("answer"), text.lower_first("c_name").alias("small"))


# Joins and alignment


@query("""
WITH x AS (SELECT c_custkey // 2 AS id, CASE WHEN c_custkey % 2 = 0 THEN 'es' ELSE 'pt' END AS lang, c_name FROM customer)
SELECT a.id, a.c_name AS source_text, b.c_name AS target_text, a.lang || '_' || b.lang AS direction, 'es_pt' AS language_pair FROM x a JOIN x b ON a.id = b.id AND a.lang <> b.lang""")
def bidirectional_pairs(spark, d):
    x = t(spark, d, "customer").select(F.floor(F.col("c_custkey") / 2).cast("long").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "es").otherwise("pt").alias("lang"), F.col("c_name").alias("text"))
    return joins.paired_languages(x, [("es", "pt")]).select("id", "source_text", "target_text", "direction", "language_pair")


def customer_fields(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Expected fields of customers, and predictions that lack, alter or add some."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    kind = F.when(F.col("field") == "nation", "number").otherwise("string")
    full = lambda x: x.unpivot("sample_id", ["name", "segment", "nation"], "field", "value").select("sample_id", "field", "value", kind.alias("kind"), kind.alias("type"))
    k = F.col("sample_id")
    p = full(c).filter(~((k % 7 == 0) & (F.col("field") == "segment")))
    p = p.withColumn("value", F.when((k % 5 == 0) & (F.col("field") == "nation"), F.lit("99")).when((k % 3 == 0) & (F.col("field") == "name"), F.lower("value")).otherwise(F.col("value")))
    extra = c.filter(k % 11 == 0).select("sample_id", F.lit("extra").alias("field"), F.lit("x").alias("value"), F.lit("string").alias("kind"), F.lit("string").alias("type"))
    return p.unionByName(extra), full(c)


_FIELDS = """
WITH f AS (SELECT c_custkey AS k, unnest(['name', 'segment', 'nation', 'extra']) AS field FROM customer),
m AS (SELECT k, field, CASE WHEN field = 'extra' THEN 'spurious' WHEN field = 'segment' AND k % 7 = 0 THEN 'missed' WHEN field = 'nation' AND k % 5 = 0 THEN 'incorrect' ELSE 'exact' END AS match_type
  FROM f WHERE field <> 'extra' OR k % 11 = 0)"""


@query(_FIELDS + " SELECT k AS sample_id, field, match_type, CASE WHEN match_type = 'exact' THEN 'none' ELSE 'critical' END AS severity, match_type IN ('exact', 'incorrect') AS type_match, field = 'nation' AS is_numeric FROM m")
def field_compare(spark, d):
    return structured.compare_fields(*customer_fields(spark, d), latin_only=True).select("sample_id", "field", "match_type", "severity", "type_match", "is_numeric")


@query(_FIELDS + """, c AS (SELECT k, count(*) FILTER (match_type = 'exact') AS ex, count(*) FILTER (match_type <> 'spurious') AS ne, count(*) FILTER (match_type <> 'missed') AS np, count(*) FILTER (match_type = 'spurious') AS sp,
  count(*) FILTER (match_type <> 'exact') AS crit, count(*) FILTER (match_type = 'exact' AND field = 'nation') AS num FROM m GROUP BY k)
SELECT k AS sample_id, round(2.0 * ex / (ne + np), 6) AS f1, round(sp / np, 6) AS hallucination_rate, round(crit / ne, 6) AS critical_error_rate, num::DOUBLE AS numeric_precision_rate,
  round(0.15::DOUBLE + 0.70::DOUBLE * (2.0 * ex / (ne + np)) + 0.15::DOUBLE * (1 - sp / np), 5) AS eqs, round(0.50::DOUBLE * num + 0.35::DOUBLE * (2.0 * ex / (ne + np)) + 0.15::DOUBLE, 5) AS des FROM c""")
def sample_rollup(spark, d):
    rolled = structured.sample_rollup(structured.compare_fields(*customer_fields(spark, d), latin_only=True)).withColumn("schema_validity", F.lit(1.0))
    return rolled.select("sample_id", r6("field_f1_partial", "f1"), r6("hallucination_rate", "hallucination_rate"), r6("critical_error_rate", "critical_error_rate"), "numeric_precision_rate", F.round(structured.quality_score(), 5).alias("eqs"), F.round(structured.document_score(), 5).alias("des"))


@query(_FIELDS + """ SELECT field, count(*) FILTER (match_type <> 'spurious') AS expected_count, count(*) FILTER (match_type = 'exact') AS exact_count, count(*) FILTER (match_type = 'missed') AS missed_count, count(*) FILTER (match_type = 'spurious') AS spurious_count,
  round(coalesce(count(*) FILTER (match_type = 'exact') / nullif(count(*) FILTER (match_type <> 'spurious'), 0), 0), 6) AS exact_accuracy, round(coalesce(count(*) FILTER (match_type IN ('missed', 'incorrect')) / nullif(count(*) FILTER (match_type <> 'spurious'), 0), 0), 6) AS error_rate,
  min(k) FILTER (match_type <> 'exact') AS first_error FROM m GROUP BY field""")
def field_diagnostics(spark, d):
    out = structured.field_diagnostics(structured.compare_fields(*customer_fields(spark, d), latin_only=True))
    return out.select("field", "expected_count", "exact_count", "missed_count", "spurious_count", r6("exact_accuracy", "exact_accuracy"), r6("error_rate", "error_rate"), F.col("examples")[0].sample_id.alias("first_error"))


@query("""
WITH k AS (SELECT c_custkey AS sample_id, CASE WHEN c_custkey % 9 = 0 THEN 'none' WHEN c_custkey % 4 = 0 THEN 'part' ELSE 'full' END AS kind FROM customer),
f AS (SELECT *, CASE kind WHEN 'full' THEN 3 WHEN 'part' THEN 1 ELSE 0 END AS exact, CASE kind WHEN 'full' THEN 3 WHEN 'part' THEN 2 ELSE 0 END AS predicted, 3 AS expected, CASE kind WHEN 'full' THEN 1.0 ELSE 0.0 END AS numbers,
  CASE kind WHEN 'part' THEN 1 ELSE 0 END AS null_words FROM k),
s AS (SELECT *, CASE WHEN exact > 0 THEN 2.0 * (exact / predicted) * (exact / expected) / (exact / predicted + exact / expected) ELSE 0.0 END AS f1 FROM f)
SELECT sample_id, kind <> 'none' AS valid, kind = 'full' AS exact_match, null_words::INT AS null_words, round(f1, 6) AS f1,
  CASE WHEN kind = 'none' THEN 0.0 ELSE round(greatest(0.0, 0.15 + 0.70 * f1 + 0.15 - 0.02 * null_words), 6) END AS eqs, CASE WHEN kind = 'none' THEN 0.0 ELSE round(greatest(0.0, 0.50 * numbers + 0.35 * f1 + 0.15 - 0.02 * null_words), 6) END AS des FROM s""")
def structured_pipeline(spark, d):
    """From JSON texts to sample scores: normalize, align, validate, flatten, compare, roll up."""
    c = t(spark, d, "customer")
    body = lambda *a: F.to_json(F.struct(*a))
    k = F.col("c_custkey")
    rows = c.select(
        k.alias("id"), body(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("2024-01-15").alias("day")).alias("expected"),
        F.when(k % 9 == 0, "no json").when(k % 4 == 0, body(F.lower("c_name").alias("name"), F.lit("null").alias("nation"))).otherwise(body(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("15-01-2024").alias("day"))).alias("prediction"),
    )
    schema = {"type": "object", "properties": {"name": {"type": "string"}, "nation": {"type": ["integer", "null"]}, "day": {"type": "string", "format": "date"}}, "required": ["name"]}
    samples, _ = structured.score_samples(rows, schema)
    return samples.select("sample_id", "valid", "exact_match", "null_words", r6("field_f1_partial", "f1"), r6("extraction_quality_score", "eqs"), r6("document_extraction_score", "des"))


@query("""
WITH e AS (SELECT l_orderkey, l_returnflag AS key, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n,
  count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS m FROM lineitem)
SELECT l_orderkey, key, count(*) AS items, max(n) AS most, sum(CASE WHEN n <= (m + 1) // 2 THEN 1 ELSE 0 END)::BIGINT AS matched FROM e GROUP BY l_orderkey, key""")
def unordered_align(spark, d):
    """Predicted: all lines of an order, backwards; expected: the first half of each flag's lines. Equal flags meet in order."""
    from pyspark.sql.window import Window

    li = t(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    w = Window.partitionBy("l_orderkey", "key").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = li.withColumns({"n": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy("l_orderkey", "key"))})
    expected = li.filter(F.col("n") <= F.floor((F.col("m") + 1) / 2)).select("l_orderkey", "key", F.col("n").alias("at"))
    predicted = li.select("l_orderkey", "key", (-F.col("n")).alias("at"))
    met = joins.align_unordered(predicted, expected, ["l_orderkey"], "key", "at")
    return met.groupBy("l_orderkey", "key").agg(F.count("*").alias("items"), F.max("occurrence").cast("long").alias("most"), F.count("e_order").alias("matched"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti_join(spark, d):
    done = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.not_done(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


@query("""
WITH base AS (SELECT 'g.task-' || n_nationkey AS task, n_name AS v, 0 AS layer FROM nation UNION ALL SELECT 'g.task_' || n_nationkey, 'disk', 1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'g.new-' || r_regionkey, r_name, 2 FROM region)
SELECT task, v FROM (SELECT *, row_number() OVER (PARTITION BY replace(task, '-', '_') ORDER BY layer DESC) AS r FROM base) WHERE r = 1""")
def overlay_merge(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("task")
    old = n.select(key("g.task-", "n_nationkey"), F.col("n_name").alias("v"))
    disk = n.filter("n_nationkey % 2 = 0").select(key("g.task_", "n_nationkey"), F.lit("disk").alias("v"))
    return joins.overlay(old, disk, r.select(key("g.new-", "r_regionkey"), F.col("r_name").alias("v")), key="task")


@query("SELECT 'g.t-' || n_nationkey AS task, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS v FROM nation")
def attach_diagnostics(spark, d):
    n = t(spark, d, "nation")
    found = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("g.t_"), F.col("n_nationkey").cast("string")).alias("task"), F.col("n_name").alias("v"))
    return joins.attach(n.select(F.concat(F.lit("g.t-"), F.col("n_nationkey").cast("string")).alias("task")), found)


@query("SELECT l, count(*) AS n FROM (SELECT unnest(list_distinct([n_name, r_name])) AS l FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY l")
def language_bridge(spark, d):
    met = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joins.bridge(met, "n_name", "r_name", name="l").groupBy("l").agg(F.count("*").alias("n"))


# Aggregates


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.select("event_id", "user_id", "value", (F.col("user_id") % 10).alias("g"), (F.col("event_type") != "error").alias("valid"), (F.col("event_type") == "purchase").alias("correct"), "event_type", "ts")


@query("""
SELECT user_id % 10 AS g, count(*) AS total_samples, count(*) FILTER (event_type <> 'error') AS valid_samples, count(*) FILTER (event_type = 'purchase') AS correct,
  round(count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type <> 'error'), 6) AS accuracy, count(*) FILTER (event_type = 'error') AS error_count, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY g""")
def mc_accuracy(spark, d):
    out = aggregates.choice_accuracy(outcomes(spark, d), ["g"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "error_rate")})


@query("""
SELECT user_id % 10 AS g, count(*) AS total_samples, count(*) FILTER (event_type <> 'error') AS valid_samples, round(avg(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END) FILTER (event_type <> 'error'), 6) AS zeroed,
  round(avg(CASE WHEN event_id % 3 <> 0 THEN value END) FILTER (event_type <> 'error'), 6) AS skipped FROM events GROUP BY g""")
def means_over_valid(spark, d):
    e = outcomes(spark, d).withColumn("m", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    a, b = aggregates.means_over_valid(e, ["m"], ["g"]), aggregates.means_over_valid(e, ["m"], ["g"], missing_is_zero=False)
    return a.select("g", "total_samples", "valid_samples", r6("m", "zeroed")).join(b.select("g", r6("m", "skipped")), "g")


@query("""
SELECT lang AS locale, grouping(lang) = 1 AS is_total, count(*) AS sample_count, count(*) FILTER (doc_id % 4 <> 0) AS valid_samples, round(count(*) FILTER (doc_id % 4 = 0) / count(*), 4) AS error_rate,
  round(avg(n_chars::DOUBLE) FILTER (doc_id % 4 <> 0), 6) AS wer FROM documents GROUP BY GROUPING SETS ((), (lang))""")
def grouped_locale_rollup(spark, d):
    x = t(spark, d, "documents").select(F.col("lang").alias("locale"), (F.col("doc_id") % 4 != 0).alias("valid"), F.col("n_chars").cast("double").alias("wer"))
    return aggregates.transcription(x, metrics=("wer",)).withColumn("wer", F.round("wer", 6))


@query("""
WITH c AS (SELECT n_name AS way, r_name AS pair, c_mktsegment AS a, substr(c_mktsegment, 1, 1) AS b, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
p AS (SELECT pair, avg(m) AS m FROM c GROUP BY pair), l AS (SELECT unnest(list_distinct([a, b])) AS lang, m FROM c)
SELECT level, name, round(m, 6) AS m FROM (SELECT 'pair' AS level, pair AS name, m FROM p UNION ALL SELECT 'overall', 'all', avg(m) FROM p UNION ALL SELECT 'language', lang, avg(m) FROM l GROUP BY lang)""")
def hierarchical_mean(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select(F.col("n_name").alias("direction"), F.col("r_name").alias("language_pair"), F.col("c_mktsegment").alias("source_language"), F.substring("c_mktsegment", 1, 1).alias("target_language"), F.col("c_acctbal").alias("m"))
    return aggregates.translation_hierarchy(c, ["m"]).filter("level <> 'direction'").select("level", "name", r6("m", "m"))


def nation_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("total_samples"), F.count_if(F.col("c_acctbal") > 0).alias("valid_samples"), F.avg("c_acctbal").alias("mse"))
    return c.join(t(spark, d, "nation"), "n_nationkey").withColumn("accuracy", F.when(F.col("n_nationkey") % 3 == 0, F.col("valid_samples") / F.col("total_samples")))


_NATIONS = """
WITH c AS (SELECT c_nationkey, n_regionkey, n_name, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS v, avg(c_acctbal) AS mse FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
x AS (SELECT *, CASE WHEN c_nationkey % 3 = 0 THEN v / n END AS accuracy FROM c)"""


@query(_NATIONS + """ SELECT n_regionkey, sum(n)::BIGINT AS total_samples, sum(v)::BIGINT AS valid_samples, round(sum(accuracy * v) / nullif(sum(CASE WHEN accuracy IS NOT NULL THEN v END), 0), 6) AS accuracy, round(sum(mse * v) / nullif(sum(v), 0), 6) AS mse,
  round(sum(coalesce(accuracy, mse) * v) / nullif(sum(v), 0), 6) AS overall_score FROM x GROUP BY n_regionkey""")
def weighted_rollup(spark, d):
    x = nation_metrics(spark, d)
    a = aggregates.sample_weighted(x, ["accuracy", "mse"], ["n_regionkey"])
    b = aggregates.overall_score(x, ["accuracy", "mse"], ["n_regionkey"]).select("n_regionkey", "overall_score")
    return a.join(b, "n_regionkey").withColumns({c: F.round(c, 6) for c in ("accuracy", "mse", "overall_score")})


@query(_NATIONS + " SELECT n_name, CASE WHEN accuracy IS NOT NULL THEN 'accuracy' ELSE 'mse' END AS metric, round(coalesce(accuracy, mse), 6) AS value FROM x")
def primary_metric(spark, d):
    name, value = aggregates.primary_metric({"accuracy": "accuracy", "mse": "mse"})
    return nation_metrics(spark, d).select("n_name", name.alias("metric"), r6(value, "value"))


@query(f"""{_SCORED}, m AS (SELECT CASE WHEN p = e OR score >= 0.95 THEN 'exact' WHEN score >= 0.5 THEN 'partial' ELSE 'incorrect' END AS match_type, score FROM z)
SELECT match_type, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent, round(avg(score) FILTER (score > 0), 6) AS mean, round(median(score) FILTER (score > 0), 6) AS median, round(coalesce(stddev_samp(score) FILTER (score > 0), 0), 6) AS stdev FROM m GROUP BY match_type""")
def match_distribution(spark, d):
    c = similarity.compare_strings("prediction", "expected")
    m = name_pairs(spark, d).select(c.match_type.alias("match_type"), c.score.alias("score"))
    stats = structured.composite_stats(m, ["match_type"]).select("match_type", r6("mean", "mean"), r6("median", "median"), r6("stdev", "stdev"))
    return structured.match_distribution(m).withColumn("percent", F.round("percent", 6)).join(stats, "match_type")


@query("""
WITH c AS (SELECT l_linenumber AS g, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F')::DOUBLE AS tp, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F')::DOUBLE AS fp, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F')::DOUBLE AS fn, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F')::DOUBLE AS tn FROM lineitem GROUP BY g)
SELECT g, round(tp / (tp + fp + fn), 6) AS iou, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((fp + fn) / (tp + fp + fn + tn), 6) AS mae FROM c""")
def mask_metrics(spark, d):
    p, e = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    c = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("g")).agg(F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn"), F.count_if(~p & ~e).alias("tn"))
    return c.select("g", *(r6(v, k) for k, v in media.mask_scores("tp", "fp", "fn", "tn").items()))


# Ranking


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'q1_lowest' WHEN o_totalprice <= b THEN 'q2_lower_mid' WHEN o_totalprice <= c THEN 'q3_upper_mid' ELSE 'q4_highest' END AS bucket FROM orders, q""")
def quartile_buckets(spark, d):
    return ranking.with_buckets(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "bucket")


@query("""
SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, min(o_totalprice) AS min, max(o_totalprice) AS max, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def quartiles(spark, d):
    out = ranking.quartiles(t(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("""
SELECT * FROM (SELECT o_orderkey, o_totalprice, 'lowest' AS side, row_number() OVER (ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR)) AS place FROM orders UNION ALL
  SELECT o_orderkey, o_totalprice, 'highest', row_number() OVER (ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) FROM orders) WHERE place <= 10""")
def top_bottom(spark, d):
    out = ranking.extremes(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return out.withColumn("place", F.col("place").cast("long"))


@query("""
SELECT event_id, row_number() OVER (ORDER BY round(value), CAST(event_id AS VARCHAR)) AS rank_asc, row_number() OVER (ORDER BY round(value) DESC, CAST(event_id AS VARCHAR)) AS rank_desc,
  round((row_number() OVER (ORDER BY round(value), CAST(event_id AS VARCHAR)) - 1) / (count(*) OVER () - 1), 6) AS percentile FROM events""")
def rank_percentile(spark, d):
    out = ranking.ranked(t(spark, d, "events").select("event_id", F.round("value").alias("v")), "v", "event_id")
    return out.select("event_id", "rank_asc", "rank_desc", r6("percentile", "percentile"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(spark, d):
    return ranking.latest(t(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT o_orderkey, CASE WHEN r <= n // 4 THEN 1 WHEN r <= n // 2 THEN 2 WHEN r <= 3 * n // 4 THEN 3 ELSE 4 END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders)""")
def equal_count_split(spark, d):
    return ranking.equal_split(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "part")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def distinct_in_order(spark, d):
    return ranking.distinct_in_order(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def first_samples(spark, d):
    return mapping.limited(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey")


# Status rules

_STATUS = """
WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id),
s AS (SELECT user_id, user_id % 10 AS g, CASE WHEN user_id % 13 = 0 THEN 'no_samples' WHEN user_id % 17 = 0 THEN 'failed' WHEN e > 0 THEN 'degraded' ELSE 'passed' END AS status,
  CASE WHEN user_id % 13 = 0 THEN 'no_samples' WHEN user_id % 17 = 0 THEN 'no_valid_samples' WHEN e > 0 THEN 'partial_errors' END AS reason FROM u)"""


def user_status(spark: SparkSession, d: str) -> DataFrame:
    u = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    total = F.when(F.col("user_id") % 13 == 0, 0).otherwise(F.col("n"))
    bad = F.when(F.col("user_id") % 13 == 0, 0).when(F.col("user_id") % 17 == 0, F.col("n")).otherwise(F.col("e"))
    return status.with_status(u.select("user_id", (F.col("user_id") % 10).alias("g"), total.alias("total_samples"), bad.alias("error_count")))


@query(_STATUS + " SELECT user_id, status, reason FROM s")
def status_rules(spark, d):
    return user_status(spark, d).select("user_id", "status", "reason")


@query(_STATUS + """ SELECT g, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'no_samples') THEN 'no_samples' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'passed' END AS status,
  CASE WHEN bool_or(status IN ('failed', 'no_samples')) THEN 1 ELSE 0 END AS smoke, CASE WHEN bool_or(status <> 'passed') THEN 1 ELSE 0 END AS strict, 0 AS relaxed, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status <> 'passed') THEN 'degraded' ELSE 'passed' END AS run_status,
  count(*) AS requested, count(*) FILTER (status = 'passed') AS passed FROM s GROUP BY g""")
def task_and_run_status(spark, d):
    s = user_status(spark, d)
    out = status.task_status(s, ["g"]).drop("reason")
    for policy in ("smoke", "strict", "relaxed"):
        out = out.join(status.exit_code(s, policy, ["g"]).withColumnRenamed("exit_code", policy), "g")
    return out.join(status.run_status(s, ["g"]), "g").join(aggregates.status_counts(s, by=["g"]).select("g", "requested", "passed"), "g")


@query("""
SELECT n_name AS subtask, CASE WHEN n_nationkey % 5 = 0 THEN 'skipped' WHEN n_nationkey % 2 = 0 THEN 'degraded' ELSE 'passed' END AS status, CASE WHEN n_nationkey % 5 = 0 THEN 'incompatible' WHEN n_nationkey % 2 = 0 THEN 'partial_errors' END AS reason FROM nation""")
def skipped_subtasks(spark, d):
    n = t(spark, d, "nation")
    m = n.select(F.col("n_name").alias("subtask"), F.lit(10).alias("total_samples"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(0).alias("error_count"))
    skips = n.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("subtask"), F.lit(None).cast("string").alias("reason"))
    return status.subtask_statuses(m, skips).select("subtask", "status", "reason")


SAID = {0: "Error code: 401", 1: "Your key: UNAUTHORIZED", 2: "status code 403", 3: "model gpt not found", 4: "insufficient_quota; error code: 429", 5: "error code: 429", 6: "Rate limit reached", 7: "Connection reset", 8: "", 9: "status code: 503"}


@query("""
WITH e AS (SELECT event_id, user_id, event_id % 10 AS k FROM events)
SELECT event_id, CASE WHEN k IN (0, 1) THEN 'invalid_api_key' WHEN k = 2 THEN 'forbidden' WHEN k = 3 THEN 'model_not_found' WHEN k = 4 THEN 'insufficient_credits' WHEN k IN (5, 6) OR (user_id % 2 = 0 AND k IN (7, 8, 9)) THEN 'rate_limited'
    WHEN k IN (7, 9) THEN 'access_error' END AS issue_code,
  CASE WHEN k IN (5, 6) OR (user_id % 2 = 0 AND k IN (7, 8, 9)) THEN 'degraded' WHEN k <> 8 THEN 'failed' END AS severity,
  CASE WHEN k IN (0, 1) THEN '401' WHEN k = 2 THEN '403' WHEN k = 3 THEN '404' WHEN k IN (4, 5, 6) THEN '429' WHEN k = 9 THEN '503' WHEN user_id % 2 = 0 THEN '429' END AS status_code FROM e""")
def error_issues(spark, d):
    e = t(spark, d, "events")
    said = F.element_at(F.create_map(*(x for k, m in SAID.items() for x in (F.lit(k), F.lit(m)))), (F.col("event_id") % 10).cast("int"))
    return e.select("event_id", status.issue(said, F.when(F.col("user_id") % 2 == 0, "rate_limit")).alias("i")).select("event_id", "i.*")


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS k, 1 + event_id % 5 AS n FROM events)
SELECT event_id, k <> 1 AS retry, CASE WHEN k IN (0, 2, 5) THEN least(120.0, 5 * power(3, n - 1)) WHEN k = 1 THEN 0.0 ELSE least(16.0, power(2, n - 1)) END AS delay,
  CASE WHEN k IN (0, 2, 5) THEN 'rate_limit' WHEN k = 1 THEN 'invalid_response' ELSE 'connectivity_error' END AS error_type FROM e""")
def retry_decisions(spark, d):
    k = F.col("event_id") % 6
    code = F.when(k == 0, 429).when(k == 1, 404).when(k == 3, 502).when(k == 5, 400)
    said = F.when(k == 2, "Rate Limit").when(k == 5, "got 429 inside").otherwise("timed out")
    return t(spark, d, "events").select("event_id", status.retry(said, code, 1 + F.col("event_id") % 5).alias("r")).select("event_id", "r.*")


@query("""
WITH e AS (SELECT event_id, event_id % 4 IN (1, 3) AS a, event_id % 4 >= 2 AS b FROM events)
SELECT event_id, CASE WHEN a THEN 'chat' WHEN b THEN 'completions' END AS auto, CASE WHEN a OR NOT b THEN 'chat' ELSE 'completions' END AS chat, CASE WHEN b OR NOT a THEN 'completions' ELSE 'chat' END AS completions FROM e""")
def endpoint_choice(spark, d):
    a, b = (F.col("event_id") % 4).isin(1, 3), F.col("event_id") % 4 >= 2
    return t(spark, d, "events").select("event_id", *(status.endpoint(F.lit(ask), a, b).alias(ask) for ask in ("auto", "chat", "completions")))


@query("""
WITH c AS (SELECT n_nationkey AS k, n_nationkey % 5 = 0 AS no_access, n_nationkey % 3 = 0 AS chat, n_nationkey % 7 <> 0 AS schema_ok, n_nationkey % 2 = 0 AS loops FROM nation)
SELECT k, CASE WHEN no_access OR NOT chat THEN 'failed' WHEN NOT schema_ok OR loops THEN 'degraded' ELSE 'passed' END AS probe_status, loops AS truncation_risk, NOT schema_ok AS schema_unreliable, loops AS repetition_risk, false AS multimodal_unreliable FROM c""")
def probe_reports(spark, d):
    k = F.col("n_nationkey")
    check = lambda kind, name, s, tested, ok, loops: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), s.alias("status"), F.lit(tested).alias("tested"), ok.alias("ok"), loops.alias("repeats"))
    no, good = F.lit(False), F.lit("passed")
    rows = [check("check", "access_readiness", F.when(k % 5 == 0, "failed").otherwise("passed"), True, k % 5 != 0, no), check("mode", "chat", good, True, k % 3 == 0, no), check("mode", "completions", good, False, no, no),
            check("transport", "structured_outputs", good, True, k % 7 != 0, no), check("transport", "response_format", good, True, no, no), check("check", "truncation", F.when(k % 2 == 0, "degraded").otherwise("passed"), True, F.lit(True), k % 2 == 0)]
    return status.probe_report(t(spark, d, "nation").select(k.alias("k"), F.inline(F.array(*rows))), ["k"])


@query(_STATUS + " SELECT user_id, g FROM s WHERE user_id % 2 = 1 OR status NOT IN ('passed', 'degraded', 'skipped', 'no_samples')")
def unfinished_tasks(spark, d):
    s = user_status(spark, d)
    return status.unfinished(s.select("user_id", "g"), s.filter("user_id % 2 = 0"), "user_id")


# Leaderboards


def market_scores(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("model"), F.lit("es").alias("category"), F.lower("o_orderstatus").alias("task")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"))


_MARKET = "WITH s AS (SELECT c_mktsegment AS model, lower(o_orderstatus) AS task, round(avg(o_totalprice), 4) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(_MARKET + " SELECT model, max(score) FILTER (task = 'f') AS es_f, max(score) FILTER (task = 'o') AS es_o, max(score) FILTER (task = 'p') AS es_p, round(avg(score), 4) AS overall_score, max(score) FILTER (task = 'f') AS sub_f FROM s GROUP BY model")
def wide_leaderboard(spark, d):
    table = leaderboard.wide(market_scores(spark, d), ["es_f", "es_o", "es_p"])
    return leaderboard.with_subcategories(leaderboard.overall(table, ["es_f", "es_o", "es_p"]), {"es_f": "sub_f"})


@query(_MARKET + " SELECT model, 'es_' || task AS column, score FROM s")
def unpivot_scores(spark, d):
    return leaderboard.unpivoted(leaderboard.wide(market_scores(spark, d), ["es_f", "es_o", "es_p"]))


@query(_MARKET + " SELECT model, count(*) AS tasks, round(min(score), 4) AS lowest FROM s GROUP BY model")
def score_breakdown(spark, d):
    b = leaderboard.breakdown(market_scores(spark, d))
    inner = F.element_at("categories", "es")
    return b.select("model", long(F.size(inner), "tasks"), F.array_min(F.map_values(inner)).alias("lowest"))


@query(_NATIONS + " SELECT CAST(n_regionkey AS VARCHAR) AS model, n_name AS task, CASE WHEN accuracy IS NOT NULL THEN 'acc' ELSE 'mse' END AS metric, round(coalesce(accuracy, mse) / 100, 6) AS score FROM x")
def processor_scores(spark, d):
    rows = nation_metrics(spark, d).select(F.col("n_regionkey").cast("string").alias("model"), F.lit("es").alias("category"), F.col("n_name").alias("task"), "accuracy", "mse")
    return leaderboard.task_scores(rows, [leaderboard.Category("es", "es", divide_by=100.0)], ["accuracy", "mse"]).select("model", "task", "metric", r6("score", "score"))


@query(_NATIONS + " SELECT n_regionkey, round(sum(accuracy * v) FILTER (v > 0) / sum(v) FILTER (v > 0 AND accuracy IS NOT NULL), 6) AS accuracy FROM x GROUP BY n_regionkey")
def weighted_scores(spark, d):
    return leaderboard.weighted_score(nation_metrics(spark, d), "accuracy", ["n_regionkey"]).select("n_regionkey", r6("accuracy", "accuracy"))


@query(_MARKET + " SELECT model, 'es' AS category, round(avg(score), 4) AS score FROM s GROUP BY model")
def category_means(spark, d):
    return leaderboard.category_scores(market_scores(spark, d)).withColumn("score", F.round("score", 4))


@query("""
WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS model, count(*) AS n, avg(c_acctbal) / 10000 AS eqs FROM customer GROUP BY ALL),
m AS (SELECT model, eqs, CASE WHEN n % 2 = 0 THEN eqs / 2 ELSE eqs END AS main, (eqs * n + 1.0 * 2) / (n + 2) AS composite FROM c)
SELECT model, unnest(['extraction_quality_score', 'composite_score', 'schema_validity', 'field_f1_partial', 'hallucination_rate']) AS task, unnest(['eqs', 'composite_mean', 'validity_rate', 'f1', 'hallucination_rate']) AS metric,
  round(unnest([main, composite, 0.5, 0.0, 0.25]), 6) AS score FROM m""")
def structured_leaderboard(spark, d):
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("model")).agg(F.count("*").alias("n"), (F.avg("c_acctbal") / 10000).alias("eqs"))
    known = F.create_map(F.lit("extraction_quality_score"), F.col("eqs"), F.lit("schema_validity_rate"), F.lit(0.5), F.lit("hallucination_rate"), F.lit(0.25))
    full = F.map_concat(known, F.create_map(F.lit("overall_extraction_quality_score"), F.col("eqs") / 2))
    part = lambda mean, n: F.struct(mean.cast("double").alias("mean"), n.cast("long").alias("valid_samples"))
    subtasks = F.array(part(F.col("eqs"), F.col("n")), part(F.lit(1.0), F.lit(2)), part(F.lit(9.0), F.lit(0)), part(F.lit(None), F.lit(5)))
    runs = c.select("model", F.when(F.col("n") % 2 == 0, full).otherwise(known).alias("metrics"), subtasks.alias("subtasks"))
    return leaderboard.processor("structured_extraction_results_processor")(runs).withColumn("score", F.round("score", 6))


@query("""
WITH r AS (SELECT CAST(n_regionkey AS VARCHAR) AS model, n_name AS task, n_nationkey / 20.0 AS wer, n_nationkey / 50.0 AS cer FROM nation WHERE n_nationkey % 4 <> 1),
s AS (SELECT *, round(greatest(0.0, 1 - wer), 4) AS score FROM r)
SELECT model, task, score, round(wer, 4) AS wer, round(cer, 4) AS cer FROM s UNION ALL SELECT model, 'overall', round(avg(score), 4), NULL, NULL FROM s GROUP BY model""")
def speech_leaderboard(spark, d):
    k = F.col("n_nationkey")
    rows = t(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("model"), F.col("n_name").alias("task"), F.when(k % 4 != 1, k / 20.0).alias("wer"), (k / 50.0).alias("cer"))
    return leaderboard.speech_scores(rows).drop("metric")


@query("SELECT event_id, event_type || '__' || user_id AS folder, event_type = 'error' AND false OR event_type = 'view' AS copied FROM events")
def copied_folders(spark, d):
    e = t(spark, d, "events").withColumn("folder", F.concat_ws("__", "event_type", "user_id"))
    named = F.when(F.col("event_type") == "view", F.concat(F.lit("qwen__"), F.col("folder"))).otherwise(F.regexp_replace("folder", "__", "_google_"))
    return e.select("event_id", "folder", leaderboard.copied_folder(named).alias("copied"))


# Tasks from samples to aggregates


@query("""
SELECT count(*) AS total_samples, count(*) FILTER (o_orderkey % 9 <> 0) AS valid_samples, count(*) FILTER (o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0) AS correct, round(count(*) FILTER (o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0) / count(*) FILTER (o_orderkey % 9 <> 0), 6) AS accuracy,
  count(*) FILTER (o_orderkey % 9 = 0) AS error_count, round(count(*) FILTER (o_orderkey % 9 = 0) / count(*), 6) AS error_rate FROM orders""")
def classification_task(spark, d):
    """Samples meet a table of predictions; every fourth one is wrong, every ninth sample has none."""
    o = t(spark, d, "orders")
    samples = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("expected"))
    right = F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")) - 1
    said = F.when(F.col("o_orderkey") % 4 == 0, (right + 1) % 3).otherwise(right).cast("string")
    predictions = o.filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('{"label": '), said, F.lit("}")).alias("prediction"))
    found = tasks.evaluate(tasks.classification("status", {"F": "filled", "O": "open", "P": "partial"}), samples, tasks.from_table(predictions)).metrics
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "error_rate")})


# Mapping, filters and functions of single rows


@query("""
SELECT 'mc' AS kind, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'exam_' || (c_custkey - 1) END AS id, c_name AS text, c_mktsegment AS expected FROM customer
UNION ALL SELECT 'freeform', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
UNION ALL SELECT 'translation', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END FROM customer""")
def task_projections(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    mc = mapping.choice_rows(c.select((k - 1).alias("row_idx"), F.when(k % 3 == 0, k).alias("id"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("expected")), "exam")
    some = c.select(k.alias("id"), F.when(k % 5 != 0, F.col("c_name")).alias("text"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("expected"))
    two = mapping.translation_rows(some.withColumnsRenamed({"text": "source_text", "expected": "target_text"}))
    kinds = {"mc": mc, "freeform": mapping.freeform_rows(some), "translation": two.withColumn("id", F.col("id").cast("string"))}
    parts = [x.select(F.lit(n).alias("kind"), "id", "text", "expected") for n, x in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TWO_SCHEMAS = ({"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}, {"type": "object", "properties": {"n": {"type": "string"}, "m": {"type": "string"}}, "required": ["m"]})


@query("""
SELECT o_orderkey AS sample_id, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS valid, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS exact_match, o_orderkey % 2 AS which FROM orders WHERE o_orderkey % 11 <> 0""")
def schema_by_row(spark, d):
    """Odd orders are to have texts, and a field m that every third one has; even ones numbers."""
    import json

    k = F.col("o_orderkey")
    body = F.when(k % 2 == 0, F.to_json(F.struct(k.alias("n")))).when(k % 3 == 0, F.to_json(F.struct(k.cast("string").alias("n"), F.col("o_orderstatus").alias("m")))).otherwise(F.to_json(F.struct(k.cast("string").alias("n"))))
    schema = F.when(k % 11 != 0, F.when(k % 2 == 0, json.dumps(_TWO_SCHEMAS[0])).otherwise(json.dumps(_TWO_SCHEMAS[1])))
    rows = mapping.structured_rows(t(spark, d, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("text"), body.alias("expected"), schema.alias("schema")))
    samples, _ = structured.score_samples(rows.withColumn("prediction", F.col("expected")), None)
    return samples.select("sample_id", "valid", "exact_match", F.when(F.col("schema_fingerprint") == jsons.fingerprint(_TWO_SCHEMAS[0]), 0).otherwise(1).cast("long").alias("which"))


@query("""
SELECT c_custkey, '{"model":"m","n":' || c_custkey || ',"text":"' || c_mktsegment || '","said":"<' || c_mktsegment || '> ' || c_custkey || '","raw":"' || base64(encode(c_mktsegment)) || '","list":["' || c_nationkey || '",true,null]}' AS body FROM customer""")
def body_template(spark, d):
    template = {"model": "m", "n": "{{k}}", "text": "{{seg}}", "said": "<{{seg}}> {{k}}", "raw": "{{seg|base64}}", "list": ["{{ nation | json }}", True, None]}
    return t(spark, d, "customer").select("c_custkey", jsons.render_body(template, k="c_custkey", seg="c_mktsegment", nation="c_nationkey").alias("body"))


@query("""
SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS tags, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS nation FROM customer""")
def filled_objects(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("where", T.StructType([T.StructField("nation", T.IntegerType())]))])
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("x").alias("unknown"), F.when(k % 2 == 0, F.array("c_mktsegment")).alias("tags"), F.when(k % 3 == 0, F.struct(F.col("c_nationkey").alias("nation"), k.alias("more"))).alias("where")))
    v = F.col("v")
    return t(spark, d, "customer").select("c_custkey", mapping.filled(body, schema).alias("v")).select("c_custkey", v["name"].alias("name"), F.size(v["tags"]).alias("tags"), v["where"]["nation"].alias("nation"))


@query("""
WITH x AS (SELECT c_custkey AS id, c_name AS a, c_mktsegment AS b FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0)
SELECT id, a AS source_text, b AS target_text, 'en_es' AS direction, 'en_es' AS language_pair FROM x UNION ALL SELECT id, b, a, 'es_en', 'en_es' FROM x""")
def both_directions(spark, d):
    k = F.col("c_custkey")
    x = t(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("a"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("b"))
    return joins.bidirectional(x, "a", "b", "en", "es").select("id", "source_text", "target_text", "direction", "language_pair")


@query("SELECT c_custkey - 1 AS row_idx, 'r' || c_custkey AS record_id FROM customer WHERE c_custkey % 10 = 0 OR (c_custkey - 1) % 7 = 0")
def record_rows(spark, d):
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select((k - 1).alias("row_idx"), F.concat(F.lit("r"), k.cast("string")).alias("record_id"))
    named = rows.filter("(row_idx + 1) % 10 = 0").select("record_id", F.lit("sample_000001").alias("sample_id"))
    placed = rows.filter("row_idx % 7 = 0").select(F.lit(None).cast("string").alias("record_id"), F.format_string("sample_%06d", "row_idx").alias("sample_id"))
    return joins.by_record(named.unionByName(placed).unionByName(placed), rows)


@query("""
SELECT p_partkey AS stem, '/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '.jpg' END AS path FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def file_choice(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("stem"))
    file = lambda x, ext: x.select("stem", F.lit(ext).alias("ext"), F.concat(F.lit("/"), F.col("stem").cast("string"), F.lit(f".{ext}")).alias("path"))
    files = file(p.filter("stem % 2 = 0"), "png").unionByName(file(p.filter("stem % 3 = 0"), "jpg")).unionByName(file(p, "txt"))
    return joins.with_listing(p, files, priority=["png", "jpg"])


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\s]+', ' ', 'g'))) AS transcript, md5(strip_accents(trim(regexp_replace(lower(text), '[\s]+', ' ', 'g')))) AS plain, md5(text) AS as_it_is FROM documents""")
def transcripts(spark, d):
    md5 = lambda c, n: F.md5(c.cast("binary")).alias(n)
    return t(spark, d, "documents").select("doc_id", md5(text.normalize_transcript("text"), "transcript"), md5(text.normalize_string("text", latin_only=True), "plain"), md5(text.normalize_string("text", True, False, False), "as_it_is"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[\s]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN repeat('go on ', 9) ELSE text END AS text FROM documents)),
g AS (SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS p, count(*) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w) GROUP BY ALL),
m AS (SELECT doc_id, max(n) AS n FROM g GROUP BY doc_id)
SELECT doc_id, len(ws) >= 12 AND coalesce(m.n, 0) >= 0.5 * (len(ws) - 1) AS looped FROM w LEFT JOIN m USING (doc_id)""")
def bigram_loops(spark, d):
    said = F.when(F.col("doc_id") % 10 == 0, F.repeat(F.lit("go on "), F.lit(9))).otherwise(F.col("text"))
    return t(spark, d, "documents").select("doc_id", text.bigram_repetition(said).alias("looped"))


_SCHEMAS = ({"type": "object", "properties": {"b": {"type": "string"}, "a": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number"}}, "required": ["x"]}}}, "required": ["b"]}, {"properties": {"o": {"type": "object", "properties": {"p": {"type": "string"}}}}}, {})


@query("""
WITH s(n, j, total_fields, required_fields, max_depth, array_fields, nested_objects) AS (VALUES
  (0, '{"properties": {"a": {"items": {"properties": {"x": {"type": "number"}}, "required": ["x"], "type": "object"}, "type": "array"}, "b": {"type": "string"}}, "required": ["b"], "type": "object"}', 3, 2, 1, 1, 0),
  (1, '{"properties": {"o": {"properties": {"p": {"type": "string"}}, "type": "object"}}}', 2, 0, 1, 0, 1), (2, '{}', 0, 0, 0, 0, 0))
SELECT n_nationkey, left(sha1(j), 12) AS fingerprint, md5(j) AS hash, '_adhoc_structured_' || left(md5(j), 8) AS name, total_fields, required_fields, max_depth, array_fields, nested_objects FROM nation JOIN s ON n = n_nationkey % 3""")
def schema_names(spark, d):
    """Names and sizes of schemas, which are the driver's, joined to the rows that have them as literals."""
    facts = [{"fingerprint": jsons.fingerprint(x), "hash": jsons.config_hash(x), "name": jsons.adhoc_name("structured", x), **jsons.complexity(x)} for x in _SCHEMAS]
    pick = lambda name: F.element_at(F.array(*(F.lit(f[name]) for f in facts)), F.col("n_nationkey") % 3 + 1).alias(name)
    return t(spark, d, "nation").select("n_nationkey", *map(pick, facts[0]))


@query(r"""
WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'items[' || p_partkey || '].name' WHEN 1 THEN 'items.name' WHEN 2 THEN 'meta.' || p_type ELSE 'total' END AS field FROM part)
SELECT p_partkey, field, regexp_matches(field, '^items\[\d+\]\.name$') OR regexp_matches(field, '^meta\..*$') AS ignored, CASE WHEN field = 'total' THEN 'reliable' WHEN regexp_matches(field, '^items') THEN 'freeform' ELSE 'unclassified' END AS tier FROM x""")
def field_patterns(spark, d):
    k = F.col("p_partkey") % 4
    x = t(spark, d, "part").select("p_partkey", F.when(k == 0, F.concat(F.lit("items["), F.col("p_partkey").cast("string"), F.lit("].name"))).when(k == 1, "items.name").when(k == 2, F.concat(F.lit("meta."), F.col("p_type"))).otherwise("total").alias("field"))
    rules = structured.StructuredRules(ignored=("items[].name", "meta.*"), reliable=("total",), freeform=("items*",))
    return x.select("p_partkey", "field", structured.matches_any(F.col("field"), rules.ignored).alias("ignored"), structured.tier(F.col("field"), rules).alias("tier"))


@query(_FIELDS + " SELECT k AS sample_id, field FROM m WHERE field NOT IN ('segment', 'extra')")
def ignored_fields(spark, d):
    return structured.compare_fields(*customer_fields(spark, d), structured.StructuredRules(ignored=("seg*", "extra"))).select("sample_id", "field")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey + 100000000, o_orderstatus FROM orders")
def split_rows(spark, d):
    """By a column, by a flag, and all rows where no row is of the split."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    named = mapping.with_split(o.withColumn("split", F.when(k % 3 == 0, "TEST").otherwise("train")), "test").drop("split")
    flagged = mapping.with_split(o.withColumn("is_test", k % 5 == 0), "test").select((-k).alias("o_orderkey"), "o_orderstatus")
    every = mapping.with_split(o.withColumn("subset", F.lit("dev")), "test").select((k + 100_000_000).alias("o_orderkey"), "o_orderstatus")
    return named.unionByName(flagged).unionByName(every)


# Rollups of data sets and runs


def extraction_samples(spark: SparkSession, d: str) -> DataFrame:
    """Sample scores from order columns: invalid ones, errors of both kinds, exact ones, and ones without numbers or tiers."""
    k = F.col("o_orderkey")
    share = lambda n: ((k % n) / F.lit(float(n)))
    o = t(spark, d, "orders").select(
        F.col("o_orderstatus").alias("g"), k.alias("sample_id"), (k % 5 != 0).alias("valid"), F.when(k % 10 == 0, "e").alias("error"), F.when(k % 20 == 0, "connectivity_error").when(k % 10 == 0, "invalid_response").alias("error_type"),
        (k % 3 == 0).alias("exact_match"), share(4).alias("hallucination_rate"), share(7).alias("field_f1_partial"), share(8).alias("field_f1_strict"), share(9).alias("extraction_quality_score"), share(11).alias("document_extraction_score"),
        share(13).alias("type_accuracy"), share(6).alias("critical_error_rate"), (k % 2).alias("numeric_fields_total"), share(16).alias("numeric_precision_rate"), F.when(k % 3 == 1, -1.0).otherwise(share(32)).alias("reliable_f1_partial"), (k % 4).cast("int").alias("null_words"),
        *((k % n).alias(m) for m, n in (("exact", 5), ("partial", 3), ("incorrect", 2), ("missed", 4), ("spurious", 7))),
    )
    return o


@query("""
WITH s AS (SELECT o_orderstatus AS g, o_orderkey AS k, o_orderkey % 5 <> 0 AS ok FROM orders)
SELECT g, count(*) AS total_samples, count(*) FILTER (ok) AS valid_samples, count(*) FILTER (k % 10 = 0) AS error_count, round(count(*) FILTER (k % 20 = 0) / count(*), 6) AS connectivity_error_rate, round(1 - count(*) FILTER (k % 20 = 0) / count(*), 6) AS response_rate,
  round(avg((k % 4) / 4.0), 6) AS hallucination_rate, round(avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_match_rate, round(avg((k % 7) / 7.0) FILTER (ok), 6) AS field_f1_partial, round(avg((k % 9) / 9.0) FILTER (ok), 6) AS extraction_quality_score,
  round(avg((k % 9) / 9.0) FILTER (ok) * (1 - count(*) FILTER (k % 10 = 0 AND k % 20 <> 0) / count(*)), 6) AS overall_extraction_quality_score, round(coalesce(avg((k % 16) / 16.0) FILTER (ok AND k % 2 = 1), 1.0), 6) AS numeric_precision_rate,
  round(avg((k % 32) / 32.0) FILTER (ok AND k % 3 <> 1), 6) AS reliable_f1_partial, round(avg((k % 9) / 9.0) FILTER (ok AND k % 3 <> 0), 6) AS imperfect_sample_quality, round(avg((k % 7) / 7.0) FILTER (ok AND k % 3 <> 0), 6) AS imperfect_sample_quality_f1,
  count(*) FILTER (ok AND k % 3 <> 0) AS imperfect_sample_count, round(stddev_samp((k % 9) / 9.0) FILTER (ok), 6) AS eqs_stdev, round(max((k % 7) / 7.0) FILTER (ok), 6) AS f1_max, round(avg(0.02 * (k % 4)) FILTER (ok), 6) AS normalization_penalty,
  sum(k % 4)::BIGINT AS null_string_conversions, sum(k % 7) FILTER (ok)::BIGINT AS spurious_count FROM s GROUP BY g""")
def dataset_rollup(spark, d):
    out = structured.dataset_rollup(extraction_samples(spark, d), ["g"])
    rounded = "connectivity_error_rate response_rate hallucination_rate exact_match_rate field_f1_partial extraction_quality_score overall_extraction_quality_score numeric_precision_rate reliable_f1_partial imperfect_sample_quality imperfect_sample_quality_f1 eqs_stdev f1_max normalization_penalty".split()
    whole = ["total_samples", "valid_samples", "error_count", "imperfect_sample_count", "null_string_conversions", "spurious_count"]
    return out.select("g", *whole, *(r6(c, c) for c in rounded))


@query(_FIELDS + """, r AS (SELECT CASE WHEN field = 'name' THEN 'rows[*].name' ELSE field END AS f, match_type FROM m),
a AS (SELECT f, count(*) FILTER (match_type <> 'spurious') AS n, count(*) FILTER (match_type = 'exact') AS x, count(*) FILTER (match_type = 'spurious') AS sp FROM r GROUP BY f),
b AS (SELECT f, n, sp, coalesce(x / nullif(n, 0), 0) AS acc FROM a)
SELECT 'worst' AS list, f AS field, n AS expected_count, sp AS spurious_count, CASE WHEN acc >= 0.99 THEN 'excellent' WHEN acc >= 0.8 THEN 'good' WHEN acc >= 0.6 THEN 'fair' ELSE 'poor' END AS band FROM (SELECT * FROM b WHERE n > 0 ORDER BY acc, n DESC, f LIMIT 2)
UNION ALL SELECT 'spurious', f, n, sp, CASE WHEN acc >= 0.99 THEN 'excellent' WHEN acc >= 0.8 THEN 'good' WHEN acc >= 0.6 THEN 'fair' ELSE 'poor' END FROM (SELECT * FROM b WHERE sp > 0 ORDER BY sp DESC, f LIMIT 5)""")
def field_lists(spark, d):
    """Indexes of arrays are one field; the worst two fields, and those that are made up."""
    fields = structured.compare_fields(*customer_fields(spark, d), latin_only=True)
    indexed = fields.withColumn("field", F.when(F.col("field") == "name", F.concat(F.lit("rows["), (F.col("sample_id") % 3).cast("string"), F.lit("].name"))).otherwise(F.col("field")))
    out = structured.field_diagnostics(indexed, collapse_indexes=True, examples=1)
    shown = lambda name, x: x.select(F.lit(name).alias("list"), "field", "expected_count", "spurious_count", "band")
    return shown("worst", structured.worst_fields(out, 2)).unionByName(shown("spurious", structured.hallucinated_fields(out, 5)))


@query("""
WITH c AS (SELECT user_id % 10 AS task, event_type AS diagnostic_class, count(*) AS n FROM events GROUP BY ALL)
SELECT diagnostic_class, sum(n)::BIGINT AS count, max(e.total) AS run_samples, round(sum(n) / max(e.total), 6) AS rate FROM c, (SELECT count(*) AS total FROM events) e GROUP BY diagnostic_class""")
def run_diagnostics(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 10).alias("task"), F.col("event_type").alias("diagnostic_class"))
    return aggregates.run_diagnostics(aggregates.class_rates(e, by=["task"]))


@query("""
WITH o AS (SELECT l_linenumber, l_orderkey, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F')::DOUBLE AS tp, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F')::DOUBLE AS fp, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F')::DOUBLE AS fn FROM lineitem GROUP BY ALL),
s AS (SELECT l_linenumber AS g, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE tp / (tp + fp + fn) END AS iou, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM o)
SELECT g, count(*) AS total_samples, round(avg(iou), 6) AS iou, round(avg(f1), 6) AS score, round(avg(CASE WHEN iou >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS acceptable_rate FROM s GROUP BY g""")
def mask_rollup(spark, d):
    p, e = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    c = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("g"), "l_orderkey").agg(F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn"), F.count_if(~p & ~e).alias("tn"))
    rows = c.select("g", *(v.alias(k) for k, v in media.mask_scores("tp", "fp", "fn", "tn").items()))
    return aggregates.mask_aggregate(rows, ["g"]).select("g", "total_samples", r6("iou", "iou"), r6("score", "score"), r6("acceptable_rate", "acceptable_rate"))


@query("""
WITH c AS (SELECT count(*) FILTER (event_type = 'click') AS zeta, count(*) FILTER (event_type <> 'click') AS beta FROM events)
SELECT CASE WHEN beta > zeta THEN 'beta' WHEN zeta > beta THEN 'zeta' ELSE 'beta' END AS by_count, 'accuracy' AS by_name FROM c""")
def run_metric(spark, d):
    e = t(spark, d, "events").select(F.when(F.col("event_type") == "click", F.col("value")).alias("zeta"), F.when(F.col("event_type") != "click", F.col("value")).alias("beta"), F.lit("x").alias("sample_id"))
    named = e.withColumns({"accuracy": F.lit(0.5), "exact_match": F.lit(float("nan")), "field_f1_partial": F.lit(None).cast("double")})
    return spark.range(1).select(F.lit(ranking.run_metric(e)).alias("by_count"), F.lit(ranking.run_metric(named)).alias("by_name"))


@query("""
SELECT count(*) AS samples, 2.5::DOUBLE AS duration_s, count(*) / 2.5::DOUBLE AS samples_per_s, (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT 'slow ' || event_type AS w FROM events WHERE event_type <> 'view')) AS warnings FROM events""")
def throughput_and_warnings(spark, d):
    e = t(spark, d, "events")
    said = e.select(F.when(F.col("event_type") != "view", F.concat(F.lit("slow "), F.col("event_type"))).alias("warning"))
    return aggregates.throughput(e, 2.5).join(aggregates.distinct_warnings(said).select(F.array_join("warnings", ",").alias("warnings")))  # a row each


# Images


def bit_masks(spark: SparkSession, d: str) -> DataFrame:
    """Two images of 16 pixels a part, drawn from the bits of two numbers: 4 x 4 with an alpha channel, and gray."""

    @F.pandas_udf("binary")
    def drawn(bits, clear):
        import numpy as np
        import pandas as pd

        on = [((int(b) >> np.arange(16)) & 1).astype(np.uint8).reshape(4, 4) * 255 for b in bits]
        return pd.Series([images.png_bytes(np.dstack([m, m, m, m]) if a else m[:, :, None]) for m, a in zip(on, clear, strict=True)])

    key = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", drawn((key * 7919) % 65536, F.lit(True)).alias("predicted"), drawn(key % 65536, F.lit(False)).alias("expected"))


_BITS = "WITH m AS (SELECT p_partkey, (p_partkey * 7919 % 65536)::BIGINT AS p, (p_partkey % 65536)::BIGINT AS e FROM part), c AS (SELECT p_partkey, bit_count(p & e)::BIGINT AS tp, bit_count(p & (65535 - e))::BIGINT AS fp, bit_count((65535 - p) & e)::BIGINT AS fn FROM m)"


@query(_BITS + " SELECT *, 16 - tp - fp - fn AS tn, round(CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE tp / (tp + fp + fn) END, 6) AS iou, false AS resized FROM c")
def image_masks(spark, d):
    """From the bytes of images to mask scores."""
    c = bit_masks(spark, d).select("p_partkey", images.image_counts("predicted", "expected").alias("c")).select("p_partkey", "c.*")
    return c.select("p_partkey", "tp", "fp", "fn", "tn", r6(media.mask_scores("tp", "fp", "fn", "tn")["iou"], "iou"), "resized")


@query(_BITS + " SELECT p_partkey, tp, fp, fn FROM c WHERE p_partkey < 100")
def mask_comparisons(spark, d):
    """Comparisons of a hundred samples, written as images and read again: pixels by colour."""
    few = bit_masks(spark, d).filter("p_partkey < 100")
    folder = new_folder(spark, "comparisons")
    sinks.write_mask_comparisons(few, folder, "p_partkey").write.format("noop").mode("overwrite").save()

    @F.pandas_udf("tp long, fp long, fn long")
    def colours(data):
        import pandas as pd

        counts = []
        for x in data:
            red, green, blue = images.png_pixels(bytes(x)).transpose(2, 0, 1).astype(int)
            counts.append((((green > red) & (green > blue)).sum(), ((red > green) & (red > blue)).sum(), ((blue > red) & (blue > green)).sum()))
        return pd.DataFrame(counts, columns=["tp", "fp", "fn"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("p_partkey"), colours("content").alias("c")).select("p_partkey", "c.*")


@query("SELECT 'es_' || n_nationkey AS id, n_name AS expected, 'es' AS locale, md5(n_name) AS digest FROM nation WHERE n_nationkey % 5 <> 0")
def speech_files(spark, d):
    """Audio bytes go to files as they are; rows without audio are dropped."""
    rows = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.struct(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name").cast("binary")).alias("bytes")).alias("audio"), F.col("n_name").alias("transcription"))
    folder = new_folder(spark, "speech")
    made = sinks.stored(readers.speech_samples(rows, folder, "es", "Spanish"), new_folder(spark, "samples"))
    name = lambda c: F.substring_index(c, "/", -1)
    files = spark.read.format("binaryFile").load(folder).select(name("path").alias("name"), F.md5("content").alias("digest"))
    return made.join(files, name(made.audio_path) == files.name).select("id", "expected", "locale", "digest")


# Sources and sinks: a table goes out through a sink or a writer and comes back through a scan


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS text, o_orderstatus AS expected FROM orders WHERE o_orderkey % 10 <> 0")
def jsonl_scan(spark, d):
    """Fields are renamed, ids become text, rows without text are dropped."""
    path = new_folder(spark, "jsonl")
    sinks.write_jsonl(t(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("question"), F.col("o_orderstatus").alias("answer")), path)
    fields = mapping.FieldMap(id="number", text="question", expected="answer")
    return readers.load_dataset(spark, readers.DatasetConfig(path, "jsonl", fields=fields)).select("id", "text", "expected")


@query("SELECT printf('sample_%06d', row_number() OVER (ORDER BY o_orderkey) - 1) AS id, o_orderpriority AS text, o_orderstatus AS expected FROM orders ORDER BY o_orderkey LIMIT 300")
def parquet_scan(spark, d):
    """The file of the split is found below data/, rows are numbered in file order, the first 300 are taken."""
    path = new_folder(spark, "parquet")
    rows = t(spark, d, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    rows.select(F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("expected")).write.parquet(f"{path}/data/test.parquet")
    t(spark, d, "nation").write.parquet(f"{path}/data/train.parquet")
    return readers.load_dataset(spark, readers.DatasetConfig(path, limit=300)).select("id", "text", "expected")


@query("""SELECT c_custkey, '"' || c_name || '", ' || c_mktsegment AS note, lower(c_mktsegment) AS label FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'BUILDING')""")
def delimited_scan(spark, d):
    """Quotes and separators inside fields, blanks around names and labels, labels in any case, others dropped."""
    path = new_folder(spark, "csv")
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias(" c_custkey "), F.format_string('"%s", %s', "c_name", "c_mktsegment").alias("note"), F.concat(F.lit(" "), "c_mktsegment").alias("label"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    found = readers.read_labelled_csv(spark, path, "label", ("household", "building"))
    return found.select(F.col("c_custkey").cast("long").alias("c_custkey"), "note", "label")


@query("SELECT 'line_' || (row_number() OVER (ORDER BY c_custkey) - 1) AS id, c_name AS text, CAST(c_nationkey AS VARCHAR) AS expected FROM customer WHERE c_custkey % 3 <> 0")
def line_scan(spark, d):
    """Short and blank lines are passed over, the others numbered in order."""
    path = new_folder(spark, "lines")
    key = F.col("c_custkey")
    line = F.when(key % 3 != 0, F.concat_ws("\t", "c_name", "c_nationkey", F.lit("more"))).when(key % 2 == 0, F.lit("")).otherwise(F.col("c_name"))
    t(spark, d, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").select(line.alias("value")).write.text(path)
    return readers.read_tsv_lines(spark, path, "line")


@query("SELECT 'n' || n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey % 2 = 0")
def json_records(spark, d):
    """One document with an object of records, cut to a file of allowed keys."""
    path, n = new_folder(spark, "records"), t(spark, d, "nation")
    records = {r.k: r.v for r in n.select(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("v")).collect()}
    sinks.write_json_document(spark, f"{path}/records.json", {k: v.asDict() for k, v in records.items()})
    sinks.write_text(spark, f"{path}/keys.txt", "\n".join(f" {k} " for k in records if int(k[1:]) % 2 == 0) + "\n\nabsent\n")
    found = readers.read_json_records(spark, f"{path}/records.json", allowed=f"{path}/keys.txt")
    return found.select("key", F.from_json("value", "name string, region int").alias("v")).select("key", "v.*")


@query("SELECT n_name AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext, n_nationkey AS nation FROM nation WHERE n_nationkey % 3 <> 0")
def document_folder(spark, d):
    """expected.json and schema.json beside files; of several files of a stem the first extension in order, without one no row."""
    path, n = new_folder(spark, "documents"), t(spark, d, "nation")
    files = n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("id"), F.col("n_name").cast("binary").alias("data"), F.explode(F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("png"))).otherwise(F.array(F.lit("pdf"), F.lit("jpg")))).alias("ext"), F.lit(0).alias("row_idx"))
    readers.materialize_binary(files, "data", path).write.format("noop").mode("overwrite").save()
    sinks.write_json_document(spark, f"{path}/schema.json", {"properties": {}})
    sinks.write_json_document(spark, f"{path}/expected.json", {f"{r.n_name}.pdf" if r.n_nationkey % 2 else r.n_name: {"nation": r.n_nationkey} for r in n.collect()})
    found = readers.read_expected(spark, path)
    return found.select("id", F.substring_index("file_path", ".", -1).alias("ext"), F.get_json_object("expected", "$.nation").cast("int").alias("nation"))


@query("SELECT printf('dir_%06d', row_number() OVER (ORDER BY n_name) - 1) AS id, n_name AS stem, 'jpeg' AS ext FROM nation")
def image_folder(spark, d):
    """Images of a folder in order of path; other files are passed over."""
    path, n = new_folder(spark, "images"), t(spark, d, "nation").select(F.col("n_name").alias("id"), F.lit(b"1").alias("data"), F.lit(0).alias("row_idx"))
    for ext in ("jpeg", "txt"):
        readers.materialize_binary(n.withColumn("ext", F.lit(ext)), "data", path).write.format("noop").mode("overwrite").save()
    return readers.read_directory(spark, path).select("id", "stem", "ext")


@query("SELECT 'r' || n_regionkey AS run_id, 'm' AS model, 't' AS task, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY n_regionkey")
def run_tables(spark, d):
    """Samples partitioned by run, model and task; a repeated write replaces its own partition alone."""
    path, n = new_folder(spark, "runs"), t(spark, d, "nation")
    for region in sorted(r[0] for r in t(spark, d, "region").select("r_regionkey").collect()):
        for _ in range(2):
            sinks.write_run(n.filter(F.col("n_regionkey") == region).select("n_name"), path, f"r{region}", "m", "t")
    return spark.read.parquet(path).groupBy("run_id", "model", "task").agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))


@query("SELECT n_name, n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE round(n_nationkey / 8, 6) END AS score FROM nation")
def board_table(spark, d):
    """A leaderboard as one CSV file and back."""
    path = new_folder(spark, "board")
    sinks.write_table(t(spark, d, "nation").select("n_name", "n_regionkey", F.when(F.col("n_nationkey") % 4 != 0, F.round(F.col("n_nationkey") / 8, 6)).alias("score")), path, ("json", "csv", "xlsx", "stats"))
    return spark.read.schema("n_name string, n_regionkey int, score double").option("header", True).csv(f"{path}.csv")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def bucket_files(spark, d):
    """A folder a bucket; one is read alone."""
    path = new_folder(spark, "buckets")
    sinks.write_buckets(t(spark, d, "events").select("event_id", F.col("event_type").alias("bucket")), path)
    return spark.read.parquet(path).groupBy(F.col("bucket").alias("event_type")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 0")
def checkpoint_resume(spark, d):
    """Two appends under one configuration, one under another: what neither of the two holds remains."""
    path, o = new_folder(spark, "done"), t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), "o_totalprice")
    for step, config in ((4, "a"), (6, "a"), (5, "b")):
        resume.append_checkpoint(o.filter(F.col("o_orderkey") % step == 0).select(F.col("id").alias("sample_id"), "o_totalprice"), path, config)
    return resume.remaining(o, resume.load_checkpoint(spark, path, "a")).select("o_orderkey")


@query("SELECT 'm' || r_regionkey AS run_model, 'g.' || r_name AS task_key, r_regionkey / 4 AS score FROM region")
def run_artifact_scan(spark, d):
    """Metrics below a run folder with model and task; files of single samples are passed over."""
    path = new_folder(spark, "artifacts")
    for r in t(spark, d, "region").collect():
        for name in ("x_metrics", "x_per_sample_metrics"):
            sinks.write_json_document(spark, f"{path}/m{r.r_regionkey}/g/{r.r_name}/{name}.json", {"metrics": {"score": r.r_regionkey / 4}})
    return readers.run_metrics(spark, path, "metrics struct<score: double>").select("run_model", "task_key", "metrics.score")


@query("SELECT r_name AS folder, 's' || r_regionkey || '_2' AS name FROM region")
def newest_summaries(spark, d):
    """The newest summary of each folder, performance summaries apart."""
    path = new_folder(spark, "summaries")
    for r in t(spark, d, "region").collect():
        for stamp, kind in ((1, ""), (2, ""), (3, "_performance")):
            sinks.write_json_document(spark, f"{path}/{r.r_name}/a_{stamp}{kind}_summary.json", {"name": f"s{r.r_regionkey}_{stamp}"})
    return readers.latest_summaries(spark, path).select(F.substring_index("folder", "/", -1).alias("folder"), "name")


@query("SELECT 'o/' || r_name AS model_name, r_regionkey + 0.5::DOUBLE AS score FROM region")
def model_submissions(spark, d):
    """Of a model's submissions the last by path."""
    path = new_folder(spark, "submissions")
    for r in t(spark, d, "region").collect():
        for at, more in (("2024", 0.0), ("2025", 0.5)):
            sinks.write_json_document(spark, f"{path}/{at}/models/{r.r_name}/model_summary.json", {"model_name": f"o/{r.r_name}", "score": r.r_regionkey + more})
    return readers.submissions(spark, path).select("model_name", "score")


@query("SELECT 'd' || r_regionkey AS name, ['a', 'b'] AS labels, r_regionkey % 2 = 0 AS has_schema FROM region")
def data_set_catalog(spark, d):
    path = new_folder(spark, "catalog")
    for r in t(spark, d, "region").collect():
        sinks.write_json_document(spark, f"{path}/d{r.r_regionkey}/dataset_info.json", {"label_distribution": {"b": 1, "a": 2}})
        if r.r_regionkey % 2 == 0:
            sinks.write_json_document(spark, f"{path}/d{r.r_regionkey}/schema.json", {"properties": {}})
    return readers.dataset_catalog(spark, path).select("name", "labels", "has_schema")
