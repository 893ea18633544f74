"""Parsing of multiple-choice answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ANSWER_MARKERS, answer_segment, col, let, normalize_choice, strip

#: Keys of an answer object, in order.
ANSWER_KEYS = ("label", "answer", "prediction", "category", "class")


def choice_label(response: Column | str, labels: Column | str) -> Column:
    """The first one-character label, in the order of the labels, that stands by itself in the response."""
    quoted = lambda lab: F.concat(F.lit(r"(?i)(?:^|\b)\Q"), lab, F.lit(r"\E(?:\b|[).:])"))
    found = lambda text, labels: F.try_element_at(F.filter(labels, lambda lab: (F.char_length(lab) == 1) & F.regexp_like(text, quoted(lab))), F.lit(1))
    return let(found, strip(response), col(labels))


def _first_index(choices: Column, test) -> Column:
    found = F.transform(choices, lambda c, i: F.when(test(c), i))
    return F.array_min(found)


def choice_index(answer: Column | str, choices: Column | str, labels: Column | str, label_to_index: Column | str | None = None, strict: bool = True, latin_only: bool = True) -> Column:
    """0-based choice: a number in range, a numeric label, a letter, a choice's text, or (if not strict) its first ten characters.

    A number in range is a place even where it is also the value of another label.
    """
    mapped = F.lit(None).cast("map<string,int>") if label_to_index is None else col(label_to_index)
    return let(lambda text, said, choices, labels, mapped: _index(text, said, choices, labels, mapped, strict), strip(answer), normalize_choice(answer, latin_only), col(choices), col(labels), mapped)


def _index(text: Column, said: Column, choices: Column, labels: Column, mapped: Column, strict: bool) -> Column:
    whole = F.when(text.rlike(r"^-*\d+$"), F.regexp_replace(text, "^-+(?=-)", "").try_cast("int"))
    whole = F.coalesce(whole, F.when(text.rlike(r"^-?\d+\.0+$"), text.try_cast("double").cast("int")))
    in_range = F.when((whole >= 0) & (whole < F.size(choices)), whole)
    by_value = F.try_element_at(mapped, whole.cast("string")).cast("int")
    letter = F.array_position(labels, choice_label(text, labels)).cast("int") - 1
    by_text = _first_index(choices, lambda c: (normalize_choice(c, True) != "") & F.contains(said, normalize_choice(c, True)))
    steps = [in_range, by_value, F.when(letter >= 0, letter), by_text]
    if not strict:
        steps.append(_first_index(choices, lambda c: (F.char_length(strip(F.lower(c))) > 10) & F.contains(F.lower(text), F.left(strip(F.lower(c)), F.lit(10)))))
    return F.when(text != "", F.coalesce(*steps))


def unwrapped(prediction: Column | str) -> Column:
    """The answer inside a JSON object (by key, else its only value) or a list of one; other texts as they are."""

    def inner(text: Column, fields: Column, items: Column) -> Column:
        keyed = F.coalesce(*(F.try_element_at(fields, F.lit(k)) for k in ANSWER_KEYS), F.when(F.size(fields) == 1, F.try_element_at(F.map_values(fields), F.lit(1))))
        listed = F.when(F.size(items) == 1, F.try_element_at(items, F.lit(1)))
        return F.when(text.rlike(r"(?s)^\{.*\}$") & fields.isNotNull(), keyed).when(text.rlike(r"(?s)^\[.*\]$") & items.isNotNull(), listed).otherwise(text)

    # Values as JSON texts: a string value keeps no quotes.
    return let(lambda text: let(inner, text, F.from_json(text, "map<string,string>"), F.from_json(text, "array<string>")), strip(prediction))


def choice_prediction(prediction: Column | str, choices: Column | str, labels: Column | str, label_to_index: Column | str | None = None, strict: bool = True, depth: int = 2, markers: tuple[str, ...] = ANSWER_MARKERS) -> Column:
    """Objects and lists are unwrapped to `depth` levels, then the segment after the last answer marker is parsed."""
    answer = col(prediction).cast("string")
    for _ in range(depth):
        answer = unwrapped(answer)
    mapped = F.lit(None).cast("map<string,int>") if label_to_index is None else col(label_to_index)
    return let(lambda text, choices, labels, mapped: choice_index(text, choices, labels, mapped, strict), answer_segment(answer, markers), col(choices), col(labels), mapped)


def logprob_choice(logprobs: Column | str, labels: list[str]) -> Column:
    """The label of the largest log-probability over its token variants (map token -> value); null if none has a finite one."""
    variants = lambda lab: [pre + lab + post for pre in ("", " ", "\n", "\n\n") for post in ("", ")", ".", ":")]
    best = [F.struct(F.array_max(F.array(*(F.try_element_at(col(logprobs), F.lit(v)) for v in variants(lab)))).alias("value"), F.lit(-i).alias("order"), F.lit(lab).alias("label")) for i, lab in enumerate(labels)]
    finite = F.filter(F.array(*best), lambda s: s.value.isNotNull() & (s.value > F.lit(float("-inf"))))
    return F.array_max(finite).label
