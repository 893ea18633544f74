"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes, plus signs, digits and identifier cues in one pass over the whole text.
From each anchor a deterministic local parser expands to the boundaries and validates what it finds. Parsers never look back
behind the end of the last span of their kind, so spans of a kind are leftmost and do not overlap; a candidate that fails
its check is passed over whole.

Base kinds: email, ip, card, phone. The method adds: url (a link with a login in it), account (letters or
digits after an identifier cue such as "account no."), iban (after the cue "IBAN", check digits valid).

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; very long texts are read whole, in one
pass; repeated rows give their spans each; spans of equal start are in order of kind; an empty table gives none; other columns are
ignored by find_pii() and kept by mask_pii().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "iban")
CUES = {"account": "account", "acct": "account", "passport": "account", "customer id": "account", "iban": "iban"}

_DIGITS = frozenset("0123456789")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@:]+(?::[^\s/?#@]*)?@[A-Za-z0-9.-]*[A-Za-z0-9]")
_NUMBER = re.compile(r"(?:[ ]?(?:no|nr|number|num|id)\b\.?)?[ ]?[:#=]?[ ]?((?=[A-Za-z-]{0,12}[0-9])[A-Za-z0-9-]*[A-Za-z0-9])", re.I)
_IBAN = re.compile(r"[ ]?[:#=]?[ ]?([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark, what in (("@", "email"), ("://", "url"), ("+", "phone")):
        found.add_word(mark, (what, len(mark)))
    for d in _DIGITS:
        found.add_word(d, ("digit", 1))
    for cue, kind in CUES.items():
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


class Finder:
    """spans(text): (kind, start, end), sorted by kind as in KINDS, then start."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)  # where the parser of a kind goes on
        for last, (what, size) in self.anchors.iter(text):
            at = last - size + 1
            if what == "digit":
                if at >= done["ip"]:
                    if m := _QUAD.match(text, at):
                        done["ip"] = m.end()
                        if all(map(_small, m[0].split("."))):
                            out["ip"].append(m.span())
                    else:  # no later digit of this run can begin one
                        done["ip"] = self._run_end(text, at)
                if at >= done["card"]:
                    m = _CHAIN.match(text, at)
                    done["card"] = m.end() if m else at + 1
                    if m and 16 <= sum(c in _DIGITS for c in m[0]) <= 19 and luhn(m[0].replace(" ", "").replace("-", "")):
                        out["card"].append(m.span())
            elif at < done[what]:
                continue
            elif what == "email":
                start = at
                while start > done["email"] and text[start - 1] in _LOCAL_CHARS:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    out["email"].append((start, m.end()))
                    done["email"] = m.end()
            elif what == "phone":
                if m := _CALL.match(text, at):
                    done["phone"] = m.end()
                    if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        out["phone"].append(m.span())
            elif what == "url":
                start = at
                while start > done["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at and (m := _LOGIN.match(text, at)):
                    out["url"].append((start, m.end()))
                    done["url"] = m.end()
            elif what == "account":
                if (at == 0 or not text[at - 1].isalnum()) and (m := _NUMBER.match(text, last + 1)) and m.start(1) > last + 1 and len(m[1]) >= 6 and sum(c in _DIGITS for c in m[1]) >= 4:
                    out["account"].append(m.span(1))
                    done["account"] = m.end()
            elif (m := _IBAN.match(text, last + 1)) and (found := self._iban(m)):
                out["iban"].append(found)
                done["iban"] = found[1]
        return [(kind, a, b) for kind in KINDS for a, b in out[kind]]

    @staticmethod
    def _run_end(text: str, at: int) -> int:
        while at < len(text) and text[at] in _DIGITS:
            at += 1
        return at

    @staticmethod
    def _iban(m: re.Match) -> tuple[int, int] | None:
        """The longest valid beginning that ends at a word's end."""
        code = m[1]
        for end in range(len(code), 14, -1):
            if (end == len(code) or code[end] == " ") and code[end - 1] != " " and iban_valid(code[:end]):
                return m.start(1), m.start(1) + end
        return None


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first and longest stands."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:  # its rest is personal data too
            at = b
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Finder()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [finder.spans(t) for t in texts]
        spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind)
        base = pa.array([joined([s for s in x if s[0] in BASE]) for x in found], pa.string())
        yield pa.record_batch([batch.column("doc_id"), spans, base], ["doc_id", "spans", "base"])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, base): all spans, and the base spans joined as kind:start:end."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}, base string")


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets; n_chars, if there, is the new length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            i = batch.schema.get_field_index("text")
            clean = pa.array([masked(t, finder.spans(t)) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.record_batch([clean if k == i else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out

