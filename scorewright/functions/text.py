r"""Text functions: Column in, Column out, all built-in expressions but `nfkd`, an Arrow UDF.

`\s` of Java covers ASCII white space only; SPACE below names what the evaluation semantics call white space (that of
Unicode and the four separators U+001C to U+001F), so strip, split and collapse agree on it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: Answer markers, in order.
ANSWER_MARKERS = ("answer", "respuesta", "label", "etiqueta", "salida", "output")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(body: Callable[..., Column], *values: Column) -> Column:
    """body of the values, each evaluated once: a lambda's variable is a value, while a Column inside a lambda is run for every element."""
    bound = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(bound), lambda b: body(*(b[f"v{i}"] for i in range(len(values)))))[0]


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(x), f"{SPACE}+", " "))


def split_words(x: Column | str) -> Column:
    return F.filter(F.split(col(x), f"{SPACE}+", -1), lambda t: t != "")


def tokens(x: Column | str) -> Column:
    """Lower-cased words (null: none)."""
    return F.coalesce(split_words(F.lower(col(x))), F.array().cast("array<string>"))


def token_list(xs: Column | str) -> Column:
    """Words of an array of strings, in order."""
    return F.coalesce(F.flatten(F.transform(F.filter(col(xs), lambda s: s.isNotNull()), tokens)), F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def nfkd(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    import unicodedata

    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)), na_action="ignore")


#: Latin letters with a mark, and the letters that their decomposition leaves; for texts in Latin scripts this stays in the JVM.
_MARKED = "".join(chr(c) for c in range(0xC0, 0x180))


def _folding() -> tuple[str, str]:
    import unicodedata

    pairs = [(c, d[0]) for c in _MARKED if len(d := [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]) == 1 and d[0] != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def fold_latin(x: Column | str) -> Column:
    """Accents off for Latin-1 and Latin Extended-A letters and combining marks, by built-ins alone."""
    return F.translate(F.regexp_replace(col(x), r"\p{M}+", ""), FOLD_FROM, FOLD_TO)


def remove_accents(x: Column | str, latin_only: bool = False) -> Column:
    return fold_latin(x) if latin_only else nfkd(col(x))


def normalize_choice(x: Column | str, latin_only: bool = False) -> Column:
    """Accents off, lower case, anything but a-z and 0-9 a space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(remove_accents(x, latin_only)), "[^a-z0-9]+", " "))


def normalize_text(x: Column | str, latin_only: bool = False) -> Column:
    """Accents off, lower case, spaces collapsed; punctuation stays."""
    return collapse(F.lower(remove_accents(x, latin_only)))


def normalize_answer(x: Column | str, case_sensitive: bool = False, collapse_spaces: bool = True) -> Column:
    """Free-form answers: ends stripped, lower case, spaces collapsed."""
    x = col(x) if case_sensitive else F.lower(col(x))
    return collapse(x) if collapse_spaces else strip(x)


def normalize_transcript(x: Column | str) -> Column:
    return collapse(F.lower(col(x)))


def normalize_string(x: Column | str, case_sensitive: bool = False, whitespace: bool = True, unicode: bool = True, latin_only: bool = False) -> Column:
    x = col(x) if case_sensitive else F.lower(col(x))
    x = collapse(x) if whitespace else x
    return remove_accents(x, latin_only) if unicode else x


def normalize_freeform(x: Column | str, abbreviations: dict[str, str] | None = None, sort_words: bool = False, latin_only: bool = False) -> Column:
    """Names and addresses: abbreviations written out where no letter is beside them, accents off, words sorted on request."""
    import re

    x = collapse(F.lower(col(x)))
    for short, full in (abbreviations or {}).items():
        x = F.regexp_replace(x, rf"(?i)(?<![a-z\xc0-\xff]){re.escape(short)}(?![a-z\xc0-\xff])", full.replace("\\", "\\\\").replace("$", "\\$"))
    x = collapse(remove_accents(x, latin_only))
    return F.array_join(F.array_sort(F.split(x, " ")), " ") if sort_words else x


def digits_only(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"\P{Nd}", "")


def shorten(x: Column | str, n: int) -> Column:
    """At most n characters, the last three dots if anything was cut."""
    x = col(x)
    return F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(max(0, n - 3))), F.lit("..."))).otherwise(x)


def truncate(x: Column | str, n: int = 20_000) -> Column:
    return F.left(col(x), F.lit(n))


def preview(x: Column | str, n: int = 500) -> Column:
    return F.substring(col(x), 1, n)


def last_position(x: Column, marker: str) -> Column:
    """1-based place of the last occurrence, 0 if none."""
    back = F.locate(marker[::-1], F.reverse(x))
    return F.when(back > 0, F.char_length(x) - back - len(marker) + 2).otherwise(0)


def answer_segment(x: Column | str, markers: tuple[str, ...] = ANSWER_MARKERS) -> Column:
    """What follows the first colon after the last marker; the stripped text if there is no marker."""

    def after(x: Column, at: Column) -> Column:
        rest = F.substring(x, at, F.char_length(x))
        colon = F.locate(":", rest)
        return strip(F.when(at == 0, x).when(colon > 0, F.substring(rest, colon + 1, F.char_length(rest))).otherwise(rest))

    places = lambda x, low: let(after, x, F.greatest(*(last_position(low, m) for m in markers)) if len(markers) > 1 else last_position(low, markers[0]))
    return let(places, col(x), F.lower(col(x)))


def yes_no(x: Column | str, words: dict[str, int]) -> Column:
    """The value of the word that stands first by itself; if none does, of the one that occurs first inside others."""
    low = F.lower(F.coalesce(col(x), F.lit("")))

    def first(place) -> Column:
        found = [F.when(place(w) > 0, F.struct(place(w).alias("at"), F.lit(i).alias("i"), F.lit(v).alias("v"))) for i, (w, v) in enumerate(words.items())]
        return F.array_min(F.filter(F.array(*found), lambda s: s.isNotNull())).v

    return F.coalesce(first(lambda w: F.regexp_instr(low, F.lit(rf"\b{w}\b"))), first(lambda w: F.locate(w, low)))


def last_float(x: Column | str, low: float | None = None, high: float | None = None, fallback: float | None = None) -> Column:
    """The last number of the text, comma or point, clipped to the range."""
    found = F.try_element_at(F.regexp_extract_all(col(x).cast("string"), F.lit(r"[-+]?\d+(?:[.,]\d+)?"), 0), F.lit(-1))
    value = F.replace(found, F.lit(","), F.lit(".")).try_cast("double")
    if low is not None:
        value = F.when(value < low, F.lit(float(low))).otherwise(value)
    if high is not None:
        value = F.when(value > high, F.lit(float(high))).otherwise(value)
    return value if fallback is None else F.coalesce(value, F.lit(float(fallback)))


def comma_decimal(x: Column | str, places: int = 1) -> Column:
    return F.replace(F.format_string(f"%.{places}f", col(x).cast("double")), F.lit("."), F.lit(","))


def format_choices(choices: Column | str, labels: Column | str) -> Column:
    """Lines `A. first`; labels beyond the choices are left out."""
    choices, labels = col(choices), col(labels)
    return F.array_join(F.zip_with(choices, F.slice(labels, 1, F.size(choices)), lambda c, lab: F.concat(lab, F.lit(". "), c)), "\n")


def fill_template(template: str, **fields: Column | str) -> Column:
    """`{name}` placeholders filled once, left to right, so a value with braces stays as it is; an unknown name raises."""
    import string

    parts = []
    for text, name, *_ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in fields:
                raise KeyError(name)
            parts.append(F.coalesce(col(fields[name]).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def join_user_messages(messages: Column | str, role: str = "user") -> Column:
    """Contents of the user's messages (role, content) by line."""
    return F.array_join(F.transform(F.filter(col(messages), lambda m: m.role == role), lambda m: m.content), "\n")


def whitespace_run(x: Column | str) -> Column:
    """Length of the longest run of space, line feed, carriage return and tab."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"[ \n\r\t]+"), 0), F.char_length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def repetition(x: Column | str, least: int = 18, window: int = 15, often: int = 6) -> Column:
    """80 white-space characters in a row, or among `least` words or more one three times in a row, or one `often` times in `window`."""
    x = F.coalesce(col(x), F.lit(""))

    def inside(words: Column, n: Column) -> Column:
        # Equal words stand together after one sort, by place: a word occurs `often` times in a window if the one `often - 1` further on is near enough.
        def found(placed: Column) -> Column:
            def looped(k: Column) -> Column:
                here, third, last = (F.get(placed, k + step) for step in (0, 2, often - 1))
                near = lambda there, far: F.coalesce((there.w == here.w) & (there.i - here.i <= far), F.lit(False))
                return (here.i < n - window) & (near(third, 2) | near(last, window - 1))

            return F.exists(F.sequence(F.lit(0), n - 1), looped)

        sorted_words = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(n >= max(least, window + 1), let(found, sorted_words)).otherwise(False)

    words = split_words(x)
    return x.rlike(rf"{SPACE}{{80,}}") | let(lambda w: inside(w, F.size(w)), words)


def bigram_repetition(x: Column | str, least: int = 12, share: float = 0.5) -> Column:
    """Whether one pair of neighbouring words makes up so large a share of all pairs."""

    def judged(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        run = lambda acc, p: F.when(acc.p == p, acc.n + 1).otherwise(1)
        longest = F.aggregate(
            F.array_sort(pairs),
            F.struct(F.lit("").alias("p"), F.lit(0).alias("n"), F.lit(0).alias("most")),
            lambda acc, p: F.struct(p.alias("p"), run(acc, p).alias("n"), F.greatest(acc.most, run(acc, p)).alias("most")),
        ).most
        return F.when(F.size(words) >= least, longest >= share * (F.size(words) - 1)).otherwise(False)

    return let(judged, split_words(F.lower(F.coalesce(col(x), F.lit("")))))


def looks_like_markup(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit("")).rlike(r"(?i)<(table|tr|td|th|html|body|div|span)\b")


# Texts of single datasets


def lower_first(x: Column | str) -> Column:
    x = col(x)
    return F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, F.char_length(x)))


def cause_effect(premise: Column | str, choice: Column | str, question: Column | str) -> Column:
    """A premise without its end mark, the connective of cause or effect, and the choice with a small first letter."""
    link = F.when(col(question) == "cause", "porque").otherwise("y por lo tanto")
    return F.concat_ws(" ", F.regexp_replace(strip(premise), r"[.!?,]+$", ""), link, lower_first(strip(choice)))


def paraphrase_side(x: Column | str) -> Column:
    return F.regexp_replace(collapse(x), r"[.,;]$", "")


def without_bracket_marks(x: Column | str) -> Column:
    return strip(F.regexp_replace(col(x), r"\[[^\]]*\]", ""))


def answer_key_index(key: Column | str, labels: Column | str, default: int | None = None) -> Column:
    """0-based place of the key: a number as it is, else its place among the labels."""
    at = F.array_position(col(labels), F.upper(strip(col(key).cast("string")))).cast("int") - 1
    found = F.coalesce(col(key).cast("string").try_cast("int"), F.when(at >= 0, at))
    return found if default is None else F.coalesce(found, F.lit(default))
