"""The corpus pipeline against plain Python, stage by stage and whole, on hostile rows; and cases of single operators that take many rows."""

import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_llm_operators import HOSTILE, WORD, check_pieces, plain_groups, plain_runs, plain_targets

import corpus_pipeline
from scorewright.llm import _arrays, _store, ann, chat, mixing, packing, pii, queries, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, near_row string, mix_at int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with near copies, null and shared ids, null and empty sources, toxic rows and clashing columns."""
    path = str(tmp_path_factory.mktemp("corpus"))
    draw = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    text = lambda n, *more: " ".join([*draw.choice(words, n), *more])
    sources = ["a", "a", "a", "b", None, ""]
    rows = [(i, t, sources[i % 6]) for i, t in enumerate(HOSTILE)]
    rows += [(100 + i, text(60, *["vile slur"] * 6) if i % 4 == 0 else text(80), sources[i % 6]) for i in range(120)]
    rows += [(None, text(30 + i), sources[i % 6]) for i in range(12)] + [(7, text(25), "b"), (7, text(26), None), (7, "", "")]
    base = text(100).split()
    rows += [(500 + i, " ".join(w if k != i % 30 else "other" for k, w in enumerate(base)), "a") for i in range(60)] + [(None, " ".join(base), "a")] * 3
    rows += [(700 + i, f"mail me at someone{i}@example.com or call +1 (269) 555-3296 " + text(20), "b") for i in range(10)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", 1) for d, t, s in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(100 + i, 1, int(i % 4 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def size(t):
    return len(WORD.findall(t or ""))


def plain_mix(rows):
    """How often each text of a source is taken whole: at least copies, one more before the cut."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    return {s: int(t + 1e-9) for s, t in plain_targets(sizes).items()}


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = docs.collect()
    stage = dict(corpus_pipeline.STAGES)

    model = queries.toxicity_model(docs, spark, folder)
    clean = _store.written(stage["toxicity"](spark, docs, folder), "clean")
    want = [r for r, s in zip(every, model.scores([r.text for r in every]), strict=True) if s < 0.5]
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(map(tuple, want), key=str) and clean.columns == docs.columns
    kept_ids = {r.doc_id for r in want}
    assert not kept_ids & {100 + i for i in range(0, 120, 4)} and {101, 102, 103} <= kept_ids

    unique = _store.written(stage["near_dedup"](spark, clean, folder), "unique")
    sets = [plain_runs(r.text) for r in want]
    group = plain_groups(range(len(want)), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    by = defaultdict(list)
    for i, r in enumerate(want):
        by[group[i]].append(r)
    got = unique.collect()
    assert len(got) == len(by) and unique.columns == docs.columns
    low = lambda rows: min((r.doc_id is None, r.doc_id or 0) for r in rows)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(map(low, by.values()))
    assert all(tuple(r) in set(map(tuple, want)) for r in got) and sum(500 <= (r.doc_id or 0) < 560 for r in got) == 1

    masked = _store.written(stage["pii"](spark, unique, folder), "masked")
    finder = pii.Finder()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in masked.collect()) == Counter((r.doc_id, x, None if x is None else len(x)) for r in got for x in [pii.masked(r.text, finder.spans(r.text))])
    assert not masked.filter("text like '%example.com%'").count() or not masked.filter("doc_id >= 700").filter("text like '%@%'").count()

    rows = masked.collect()
    mixed = _store.written(stage["mixing"](spark, masked, folder), "mixed")
    taken, copies = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += size(r.text)
        copies[r.doc_id, r.source] += 1
    targets = plain_mix(rows)
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in targets.items() if n} and mixed.columns == docs.columns
    assert None in taken and "" in taken and any(d is None for d, _ in copies)

    pieces = stage["packing"](spark, mixed, folder).collect()
    plain = [(r.doc_id, r.text, r.source) for r in mixed.collect()]
    check_pieces([p.asDict() for p in packing.pack(mixed, public_tokenizers.path("word_bpe_49k.json")).collect()], plain, 2048)
    by_run = corpus_pipeline.run(spark, folder).collect()
    key = lambda ps: Counter((p.doc_id, p.start, p.doc_tokens) for p in ps)
    assert sum(key(by_run).values()) > 0 and sum(p.length for p in by_run) == sum(p.length for p in pieces)
    assert Counter(p.source for p in by_run).keys() == Counter(p.source for p in pieces).keys()


def test_run_on_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_go_with_their_owner(spark):
    with _store.scratch() as keep:
        gone, kept = _store.written(spark.range(3), "gone"), keep(_store.written(spark.range(4), "kept"))
    assert kept.count() == 4
    files, target = _store._place(spark, gone._scorewright_path)
    assert not files.exists(target)
    _store.forget(kept)


# 1 packing: rounds simulated one by one


def plain_stream(totals, weights, window, least):
    """The queue of each token of the stream: each round adds a quantum, queues that reach their unit are served whole units."""
    phi = [window * w / sum(weights) for w in weights]
    unit = [min(window, max(int(np.ceil(p)), least)) for p in phi]
    served, out, r = [0] * len(totals), [], 0
    while any(s < t for s, t in zip(served, totals, strict=True)):
        r += 1
        for q, total in enumerate(totals):
            upto = total if r * phi[q] >= total else int(r * phi[q] // unit[q]) * unit[q]
            out += [(q, i) for i in range(served[q], upto)]
            served[q] = max(served[q], upto)
    return out


@pytest.mark.parametrize(("totals", "weights", "window", "least"), [([600, 300, 100], [6, 3, 1], 100, 10), ([500, 40, 7], [1, 1, 1], 64, 16), ([333], [1], 50, 50), ([90, 210], [2, 0.5], 40, 1)])
def test_packing_is_the_round_robin(totals, weights, window, least):
    rounds = packing.Rounds(np.array(totals), np.array(weights, float), window, least)
    place = {}
    for q, total in enumerate(totals):
        step = max(1, total // 5)
        for a in range(0, total, step):
            row, start, length, at = packing.cut(rounds, np.array([q]), np.array([a]), np.array([min(total, a + step)]))
            for s, n, p in zip(start.tolist(), length.tolist(), at.tolist(), strict=True):
                assert p // window == (p + n - 1) // window
                place |= {p + i: (q, a + s + i) for i in range(n)}
    assert [place[i] for i in range(sum(totals))] == plain_stream(totals, weights, window, least)


def test_every_window_holds_every_source():
    totals = np.array([60_000, 30_000, 10_000])
    rounds = packing.Rounds(totals, totals, 1000, 100)
    filled = np.zeros((100, 3))
    for s, total in enumerate(totals):
        row, start, length, place = packing.cut(rounds, np.array([s]), np.array([0]), np.array([total]))
        np.add.at(filled, (place // 1000, s), length)
    assert (filled[:99] > 0).all() and np.abs(filled - [600, 300, 100]).max() <= 100


# 5 and 8: time in proportion


def test_a_long_conversation(spark):
    n = 50_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é### </turn> "), F.col("id").cast("string")).alias("text"))
    began = time.monotonic()
    r = chat.read_back(chat.format_trees(chat.linear(rows), distinct=True)).select("loss_text", F.size("turns").alias("n"), F.size("loss_mask").alias("masks")).first()
    assert (r.n, r.masks) == (n, n // 2) and r.loss_text == "".join(f"é### </turn> {i}" for i in range(1, n, 2))
    assert time.monotonic() - began < 120


def test_messages_without_ids(spark):
    rows = [(1, None, None, "user", "a", 0.0), (1, None, None, "user", "b", 5.0), (1, 1, None, "user", "c", 1.0), (1, 2, 1, "assistant", "d", 1.0), (1, 2, 1, "assistant", "e", 1.0)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    got = {r.branch: [t.text for t in r.turns] for r in chat.read_back(chat.format_trees(df, branches=9)).collect()}
    assert got == {1: ["b"], 2: ["c", "d"], 3: ["a"]}


def test_many_matches(spark):
    n = 100_000
    text = "token=abcdefg k7Qz9vXw2LpR8sT1uYb4NcE6mHj " * (n // 2)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    table = secrets.train(secrets.generated_samples(spark))
    began = time.monotonic()
    r = secrets.find_secrets(df, table).select(F.size("base").alias("base"), F.size("spans").alias("spans"), F.element_at("spans", -1).alias("last")).first()
    assert (r.base, r.spans, r.last.kind, r.last.end) == (n // 2, n, "random", len(text) - 1)
    assert time.monotonic() - began < 180


def test_a_key_behind_a_path(spark):
    table = secrets.train(secrets.generated_samples(spark))
    key = "k7Qz9vXw2LpR8sT1uYb4Nc"
    df = spark.createDataFrame([(1, f"see /services/billing/production/customer/session/{key} now"), (2, "see /services/billing/production/customer/session/list now")], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in secrets.find_secrets(df, table).collect()} == {1: 1, 2: 0}


def test_running_sums_and_cuts(spark):
    xs = list(range(1, 1001))
    text = "aé🙂" * 30_000
    spans = [(0, 3), (32_767, 32_770), (5, 5), (10, 80_000)]
    df = spark.createDataFrame([(xs, text, spans), ([], "", []), (None, None, None)], "xs array<long>, t string, s array<struct<start:long,end:long>>")
    got = df.select(_arrays.running(F.col("xs")).alias("sums"), _arrays.texts_at(F.col("t"), F.col("s")).alias("cut")).collect()
    assert got[0].sums == np.cumsum(xs).tolist() and got[0]["cut"] == [text[a:b] for a, b in spans] and got[1]["cut"] == []


# 6: repeated ids and copies in every slice


def test_classes_of_a_crowd(spark):
    rows = [(i, 1, 1) for i in range(5000)] + [(6000, 2, 2), (6000, 2, 2), (6001, 2, 3)]
    got = defaultdict(list)
    for r in ann.classes(spark.createDataFrame(rows, "vec_id long, h1 long, h2 long"), 20).collect():
        got[r.class_id].append(r.vec_id)
    assert sorted(got[0]) == list(range(21)) and sorted(got[6000]) == [6000, 6000] and got[6001] == [6001]


# 7: n-grams, ratios and scores in plain Python

M = 1 << 64


def plain_hash(gram):
    mix, step, n = 0x9E3779B97F4A7C15, 0x100000001B3, len(gram)
    h = ord(gram[0]) * mix % M
    for c in gram[1:]:
        h = (h * step % M) ^ (ord(c) * mix % M)
    h = (h ^ (h >> 29)) * (mix + 2 * n) % M
    return h ^ (h >> 32)


def plain_grams(text):
    t = f" {(text or '').lower()} "
    return {plain_hash(t[i : i + n]) for n in (3, 4, 5, 6) for i in range(len(t) - n + 1)}


def test_toxicity_against_plain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id between 100 and 219").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").unionByName(spark.createDataFrame([(101, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int"))
    model = toxicity.train(docs, labels, features=200)
    rows = [(r.doc_id, plain_grams(r.text), int((r.doc_id - 100) % 4 == 0)) for r in docs.collect() if r.doc_id != 101]  # labelled both ways
    grams = model.grams.tolist()
    n = Counter(y for *_, y in rows)
    counts = {g: [sum(g in found for _, found, y in rows if y == k) for k in (0, 1)] for g in grams}
    assert 100 < len(grams) <= 200 and all(sum(c) >= 3 for c in counts.values())
    ratio = np.array([np.log((b + 1) / (n[1] + 2)) - np.log((a + 1) / (n[0] + 2)) for a, b in counts.values()])
    x = np.array([[g in found for g in grams] for _, found, _ in rows], float)
    y = np.array([k for *_, k in rows], float)
    z = model.bias + x @ model.weights
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert [got[d] for d, *_ in rows] == pytest.approx(1 / (1 + np.exp(-z)))
    # The weights are those of scaled features, v = w * ratio, at which the penalized loss is flat.
    v = model.weights / ratio
    slope = (x * ratio).T @ (1 / (1 + np.exp(-z)) - y) + v
    assert np.abs(slope).max() < 0.05 and abs((1 / (1 + np.exp(-z)) - y).sum()) < 0.05


# 9: hot ids and many sources


@pytest.mark.parametrize("digits", [1, 3])
def test_mix_of_hot_ids(spark, digits):
    rows = [(None, "same words here", "hot")] * 70 + [(3, f"x{i} " * (1 + i % 4), "hot") for i in range(70)] + [(i, "w " * (i % 9), f"s{i % 40}") for i in range(300)] + [(1, None, None), (2, "a b", None), (2, "a b c", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    for r in mixing.mix(docs, digits=digits).collect():
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] + r["cut"]
    want = plain_targets(sizes)
    assert {s: taken[s] for s in want} == {s: int(t + 1e-9) for s, t in want.items()}
    out = Counter()
    for r in mixing.mixed(docs, digits=digits).collect():
        out[r.source] += size(r.text)
    assert {s: out[s] for s in want} == {s: int(t + 1e-9) for s, t in want.items()}


def test_checksum_of_the_pipeline(spark, folder):
    first = corpus_pipeline.run(spark, folder).collect()
    assert {f.name for f in corpus_pipeline.run(spark, folder).schema.fields} >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"}
    assert all(p.ids_crc32 < 1 << 32 and 0 < p.length <= 2048 for p in first) and zlib.crc32(b"") == 0 and isinstance(corpus_pipeline.run(spark, folder).schema, T.StructType)
