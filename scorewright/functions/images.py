"""Pixels of PNG images and masks derived from them: Arrow UDFs over numpy and zlib. Other formats go through a decoder that the caller gives."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colours and opacities of a mask comparison, and how far its picture is darkened.
TRUE_POSITIVE, FALSE_POSITIVE, FALSE_NEGATIVE = (0, 255, 0, 180), (255, 0, 0, 200), (0, 100, 255, 200)
BASE_SHARE = 0.6
COUNTS = "tp long, fp long, fn long, tn long, resized boolean, error string"
#: Channels by PNG colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the seven passes of an interlaced image.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))

Decoder = Callable[[bytes], np.ndarray]


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(raw: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """Rows of bytes from rows that each begin with their filter; step: bytes a pixel."""
    lines = np.frombuffer(raw, np.uint8, rows * (width + 1)).reshape(rows, width + 1)
    out = np.zeros((rows + 1, width + step), np.uint8)  # a row and a pixel of zeros before the first
    for y in range(rows):
        kind, line, above, here = lines[y, 0], lines[y, 1:], out[y], out[y + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 2:
            here[step:] = line + above[step:]
        elif kind == 1:
            for c in range(step):
                here[step + c :: step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            up, now = above.tolist(), [0] * (width + step)
            for i, x in enumerate(line.tolist(), step):
                a, b, c = now[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = (x + guess) & 255
            here[:] = now
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def png_pixels(data: bytes) -> np.ndarray:
    """Rows x columns x channels of 8 bits: 1 gray, 2 gray and alpha, 3 colours, 4 colours and alpha. Deeper samples give their high byte, palettes their colours."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG image")
    header, palette, body = None, None, []
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = header
    channels, raw, at = _CHANNELS[colour], zlib.decompress(b"".join(body)), 0
    out = np.zeros((height, width, channels), np.uint8)
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * channels * depth // 8)
        rows = _unfiltered(raw[at : at + h * (line + 1)], h, line, max(1, channels * depth // 8))
        at += h * (line + 1)
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
            rows = bits @ (1 << np.arange(depth)[::-1])
            rows = rows if colour == 3 else rows * (255 // ((1 << depth) - 1))
        out[y0::dy, x0::dx] = rows[:, : w * channels].reshape(h, w, channels)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        return palette[out[:, :, 0]]
    return out


def png_bytes(pixels: np.ndarray, texts: dict[str, str] | None = None) -> bytes:
    """A PNG of rows x columns x channels; texts: Latin-1 notes in the file."""
    height, width, channels = pixels.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.zeros((height, width * channels + 1), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    notes = b"".join(part(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1")) for k, v in (texts or {}).items())
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + notes + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of colours by the usual weights, rounded."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    red, green, blue = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return ((299 * red + 587 * green + 114 * blue + 500) // 1000).astype(np.uint8)


def predicted_mask(pixels: np.ndarray, alpha_above: int = 1, gray_below: int = 250) -> np.ndarray:
    """Foreground of a predicted image: what is not transparent, else, without an alpha channel, what is not almost white."""
    return pixels[:, :, -1] > alpha_above if pixels.shape[2] in (2, 4) else gray(pixels) < gray_below


def expected_mask(pixels: np.ndarray, above: int = 127) -> np.ndarray:
    return gray(pixels) > above


def scaled(pixels: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """To other rows and columns, by the pixel whose square holds each new centre."""
    ys, xs = (((np.arange(new) + 0.5) * old / new).astype(int) for new, old in zip(shape, pixels.shape, strict=False))
    return pixels[ys][:, xs]


def mask_pair(predicted: bytes, expected: bytes, decode: Decoder = png_pixels) -> tuple[np.ndarray, np.ndarray, bool]:
    """Both masks in the expected one's size, and whether the predicted one had to be scaled."""
    p, e = predicted_mask(decode(predicted)), expected_mask(decode(expected))
    return (p, e, False) if p.shape == e.shape else (scaled(p, e.shape), e, True)


def image_counts(predicted: Column | str, expected: Column | str, decode: Decoder = png_pixels) -> Column:
    """(tp, fp, fn, tn, resized, error) of a predicted image and an expected mask, both bytes. What can't be read has null counts and an error."""

    @F.pandas_udf(COUNTS)
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                rows.append((None, None, None, None, None, "an image is missing"))
                continue
            try:
                p, e, resized = mask_pair(bytes(x), bytes(y), decode)
            except Exception as exc:  # whatever a broken file makes a decoder raise is the row's error
                rows.append((None, None, None, None, None, str(exc) or type(exc).__name__))
                continue
            rows.append((int((p & e).sum()), int((p & ~e).sum()), int((~p & e).sum()), int((~p & ~e).sum()), resized, None))
        out = pd.DataFrame(rows, columns=["tp", "fp", "fn", "tn", "resized", "error"])
        return out.astype({**dict.fromkeys(("tp", "fp", "fn", "tn"), "Int64"), "resized": "boolean", "error": "object"})

    return count(col(predicted), col(expected))


def comparison(p: np.ndarray, e: np.ndarray, picture: np.ndarray | None = None) -> np.ndarray:
    """What both masks hold, what only the predicted and only the expected one holds, each in its colour over the darkened picture or over white."""
    base = np.full((*e.shape, 3), 255.0)
    if picture is not None:
        base = scaled(picture, e.shape)[:, :, :3].astype(float)
        base = BASE_SHARE * (base if base.shape[2] == 3 else np.repeat(base[:, :, :1], 3, axis=2))
    for where, (*colour, opacity) in ((p & e, TRUE_POSITIVE), (p & ~e, FALSE_POSITIVE), (~p & e, FALSE_NEGATIVE)):
        base[where] += (np.array(colour) - base[where]) * (opacity / 255)
    return np.rint(base).astype(np.uint8)


def comparison_png(predicted: Column | str, expected: Column | str, picture: Column | str | None = None, decode: Decoder = png_pixels) -> Column:
    """PNG bytes of the comparison, null where an image can't be read. The file's notes hold the legend and the counts."""

    @F.pandas_udf("binary")
    def draw(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x, y, z) -> bytes | None:
            try:
                p, e, _ = mask_pair(bytes(x), bytes(y), decode)
            except Exception:  # as image_counts() reports
                return None
            try:
                base = None if z is None else decode(bytes(z))
            except Exception:  # a picture that can't be read is left out, as one that is missing
                base = None
            notes = {"Legend": "green: both, red: predicted only, blue: expected only", "Counts": f"tp {(p & e).sum()} fp {(p & ~e).sum()} fn {(~p & e).sum()} tn {(~p & ~e).sum()}"}
            return png_bytes(comparison(p, e, base), notes)

        return pd.Series([one(*x) for x in zip(a, b, c, strict=True)], dtype=object)

    return draw(col(predicted), col(expected), F.lit(None).cast("binary") if picture is None else col(picture))
