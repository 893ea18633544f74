"""Images, workbooks, YAML and paths: against encoders and parsers written here."""

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.functions import images, media
from scorewright.plans import config
from scorewright.sources import readers, sinks

COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, step, kinds):
    """Each row with a filter of its own, byte by byte."""
    out, above = b"", [0] * rows.shape[1]
    for line, kind in zip(rows.tolist(), kinds, strict=True):
        made = []
        for i, x in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            made.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *made])
        above = line
    return out


def encoded(width, height, depth, colour, body, palette=b"", interlaced=0):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    return images.SIGNATURE + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_every_filter(channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (10, 7, channels), dtype=np.uint8)
    body = filtered(pixels.reshape(10, -1).astype(int), channels, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0])
    assert (images.png_pixels(encoded(7, 10, 8, COLOUR[channels], body)) == pixels).all()
    assert (images.png_pixels(images.png_bytes(pixels, {"Note": "x"})) == pixels).all()


def test_depths_palettes_and_interlacing():
    bits = np.array([[1, 0, 1, 1, 0, 0, 1, 0, 1], [0, 1, 1, 0, 0, 1, 0, 1, 0]], np.uint8)
    packed = np.packbits(bits, axis=1)
    body = b"".join(b"\0" + r.tobytes() for r in packed)
    assert (images.png_pixels(encoded(9, 2, 1, 0, body))[:, :, 0] == bits * 255).all()
    colours = images.png_pixels(encoded(9, 2, 1, 3, body, palette=bytes([1, 2, 3, 7, 8, 9])))
    assert colours[0, 0].tolist() == [7, 8, 9] and colours[0, 1].tolist() == [1, 2, 3]
    deep = b"\0" + struct.pack(">3H", 0x0102, 0xFF00, 0x8001)
    assert images.png_pixels(encoded(3, 1, 16, 0, deep))[0, :, 0].tolist() == [1, 255, 128]
    for w, h in ((11, 9), (1, 1), (3, 5)):
        pixels = np.random.default_rng(w).integers(0, 256, (h, w, 3), dtype=np.uint8)
        body = b""
        for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
            part = pixels[y0::dy, x0::dx]
            if part.size:
                body += filtered(part.reshape(len(part), -1).astype(int), 3, [4] * len(part))
        assert (images.png_pixels(encoded(w, h, 8, 2, body, interlaced=1)) == pixels).all()


def test_masks(spark):
    alpha = np.zeros((2, 2, 4), np.uint8)
    alpha[0, :, 3] = (2, 1)
    assert images.predicted_mask(alpha).tolist() == [[True, False], [False, False]]
    assert images.predicted_mask(np.array([[[249], [250]]], np.uint8)).tolist() == [[True, False]]
    assert images.expected_mask(np.array([[[127], [128]]], np.uint8)).tolist() == [[False, True]]
    assert images.scaled(np.array([[1, 2], [3, 4]]), (4, 4)).tolist() == [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]
    white, black = (images.png_bytes(np.full((4, 4, 1), v, np.uint8)) for v in (255, 0))
    rows = spark.createDataFrame([(0, black, white), (1, images.png_bytes(alpha), white), (2, b"no image", white), (3, None, white), (4, white, black)], "k int, p binary, e binary")
    got = {r.k: r.c for r in rows.select("k", images.image_counts("p", "e").alias("c")).collect()}
    assert tuple(got[0])[:5] == (16, 0, 0, 0, False) and tuple(got[1])[:5] == (4, 0, 12, 0, True)
    assert got[2].error and got[2].tp is None and got[3].error == "an image is missing" and tuple(got[4])[:4] == (0, 0, 0, 16)
    empty = spark.range(1).select(*(v.alias(k) for k, v in media.mask_scores(F.lit(0), F.lit(0), F.lit(0), F.lit(16)).items())).first()
    assert (empty.iou, empty.f1, empty.accuracy, empty.mae) == (0.0, 0.0, 1.0, 0.0)


def test_comparisons(spark, tmp_path):
    p, e = np.array([[True, True, False, False]]), np.array([[True, False, True, False]])
    assert images.comparison(p, e).tolist() == [[[75, 255, 75], [255, 55, 55], [55, 133, 255], [255, 255, 255]]]
    assert images.comparison(p, e, np.full((1, 4, 1), 100, np.uint8))[0, 3].tolist() == [60, 60, 60]
    img = lambda m: images.png_bytes(np.where(m, 0, 255).astype(np.uint8)[:, :, None])
    rows = spark.createDataFrame([("a", img(p), img(~e)), ("b", b"x", img(e))], "id string, predicted binary, expected binary")
    out = sinks.write_mask_comparisons(rows, str(tmp_path / "out"), "id").collect()
    assert [r.id for r in out] == ["a"] and b"Legend" in (tmp_path / "out" / "a.png").read_bytes()


def test_base64(spark):
    cases = {"aGVsbG8=": b"hello", "data:image/png;base64,aGVsbG8": b"hello", "```\naGVs\nbG8\n```": b"hello", "`": None}
    rows = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: r.y for r in rows.select("x", media.decode_base64("x").alias("y")).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == cases


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([("a <&> é", 1, 0.5, True, None, ["x"]), ("b", None, float("nan"), False, "t\x01u", [])], "s string, n int, x double, b boolean, z string, l array<string>")
    sinks.write_table(df.orderBy("s"), str(tmp_path / "board"), ("xlsx", "stats"))
    with zipfile.ZipFile(io.BytesIO((tmp_path / "board.xlsx").read_bytes())) as book:
        assert book.testzip() is None and all(ET.fromstring(book.read(n)) is not None for n in book.namelist())
        sheet = ET.fromstring(book.read("xl/worksheets/sheet1.xml"))
    cells = {c.get("r"): "".join(c.itertext()) for c in sheet.iter() if c.tag.endswith("}c")}
    assert cells == {"A1": "s", "B1": "n", "C1": "x", "D1": "b", "E1": "z", "F1": "l", "A2": "a <&> é", "B2": "1", "C2": "0.5", "D2": "1", "F2": '["x"]', "A3": "b", "D3": "0", "E3": "tu", "F3": "[]"}
    assert '"numeric_columns": [\n    "x"\n  ]' in (tmp_path / "board_statistics.json").read_text()
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.write_table(df, str(tmp_path / "more"), ("xlsx",), most_models=1)
    assert [sinks._sheet_column(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_metadata(tmp_path):
    pytest.importorskip("yaml")
    for name, body in {
        "b/metadata.yaml": "group: zoo\ndisplay_name: B\nsubtasks:\n  t1: {description: one, url: u}\n  t2: {}\n",
        "a/metadata.yaml": "group: translation\nsubtasks: [t3, 4]\ntask_metadata:\n  t3: {description: three}\n",
        "c/metadata.json": '{"group": "zoo", "subtasks": {"t4": {"primary_metric": "f1"}}, "defaults": {"k": 1}}',
        "_x/metadata.yaml": "group: zoo\n", "bad/metadata.yaml": "a: [\n", "none/metadata.yaml": "name: n\n",
    }.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(body)
    tasks, groups = config.reference_tables(str(tmp_path))
    assert list(groups["task_groups"]) == ["translation", "zoo"] and groups["task_groups"]["zoo"] == {"name": "B", "description": "", "subtasks": ["t1", "t4"]}
    assert tasks["tasks"]["t1"] == {"name": "t1", "group": "zoo", "description": "one", "URL": "u"} and set(tasks["tasks"]) == {"t1", "t3", "t4"}
    (tmp_path / "bad" / "metadata.yaml").unlink()
    found = config.task_catalog(str(tmp_path))
    assert [s.key for s in found["b"]] == ["b.t1", "b.t2"] and found["c"][0].config == {"k": 1, "primary_metric": "f1"} and [s.name for s in found["none"]] == ["none"]


def test_emitted_configuration():
    made = config.emitted_config("m", "p", ["t"], {"model": {"size": None, "more": {"x": {}}}, "limit": 0})
    assert config.parsed_document(made) == {"model": {"name": "m"}, "provider_type": "p", "tasks": ["t"], "limit": 0}
    assert config.parsed_document(config.emitted_config("m", "p", ["t"], form="yaml")) == {"model": {"name": "m"}, "provider_type": "p", "tasks": ["t"]}
    assert config.config_faults({"model": {}}) == ["model.name is missing", "tasks is missing"] and not config.config_faults({"model": {"name": "m"}, "tasks": ["t"]})


def test_documents_of_many_lines_and_paths_with_blanks(spark, tmp_path):
    root = tmp_path / "a run+1 (x)"
    sinks.write_json_document(spark, f"{root}/m/g/t 1/x_metrics.json", {"metrics": {"wer": 0.5}})
    got = readers.run_metrics(spark, str(root)).collect()
    assert [(r.run_model, r.task_key) for r in got] == [("m", "g.t 1")]
    sinks.write_json_document(spark, f"{root}/map.json", {"k": {"a": 1}, "l": {"a": 2}})
    assert {r.key for r in readers.read_json_map(spark, f"{root}/map.json").collect()} == {"k", "l"}


def test_speech_samples(spark, tmp_path):
    rows = spark.createDataFrame([(1, (bytearray(b"RIFF"),), "hola"), (2, None, "x")], "id int, audio struct<bytes: binary>, transcription string")
    got = readers.speech_samples(rows, str(tmp_path / "w"), "es", "Spanish").collect()
    assert [(r.id, r.expected, r.language, r.locale) for r in got] == [("es_1", "hola", "Spanish", "es")] and (tmp_path / "w" / "1.wav").read_bytes() == b"RIFF"
