"""Base64 payloads and mask scores, as expressions. Pixels are in images.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import f1, ratio
from .text import col


def decode_base64(x: Column | str) -> Column:
    """Bytes of a data URL or bare base64; fences and white space are dropped and missing padding added, broken input is null."""
    text = F.regexp_replace(F.regexp_replace(col(x), r"(?s)^\s*`{3}`*(.*?)`*\s*$", "$1"), r"(?s)^\s*data:[^,]*,", "")
    body = F.regexp_replace(text, r"\s+", "")
    body = F.translate(body, "-_", "+/")
    padded = F.rpad(body, F.greatest(F.lit(0), (F.ceil(F.char_length(body) / 4.0) * 4).cast("int")), "=")
    return F.try_to_binary(padded, F.lit("base64"))


def mask_counts(predicted: Column, expected: Column) -> Column:
    """(tp, fp, fn, tn) of two arrays of booleans of equal length."""
    pair = F.zip_with(predicted, expected, lambda p, e: F.struct(p.alias("p"), e.alias("e")))
    count = lambda p, e: F.size(F.filter(pair, lambda x: (x.p == p) & (x.e == e))).cast("long")
    return F.struct(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), count(False, False).alias("tn"))


def mask_scores(tp: Column | str, fp: Column | str, fn: Column | str, tn: Column | str) -> dict[str, Column]:
    """IoU, precision, recall, F1, accuracy and mean absolute error; a share of nothing is 0, so two empty masks have IoU 0."""
    tp, fp, fn, tn = map(col, (tp, fp, fn, tn))
    union, every = tp + fp + fn, tp + fp + fn + tn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "iou": ratio(tp, union),
        "precision": precision,
        "recall": recall,
        "f1": f1(precision, recall),
        "accuracy": ratio(tp + tn, every),
        "mae": ratio(fp + fn, every),
    }
