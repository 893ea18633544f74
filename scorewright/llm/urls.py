"""URL rules by a cascade of Bloom filters, with DataFrame functions only.

A rule is a host and a path beginning. A url's candidate keys are its host's endings at label borders with its
path's beginnings, of the label counts and lengths that the rules have. Level 1 of a cascade encodes the listed keys;
level 2 the keys of the corpus's whole universe of candidates that level 1 takes wrongly for listed; level 3 the listed keys that
level 2 takes for those, and so on until a level errs on none. A key is listed if the first level that misses it is
even. That is exact for every key of the universe, and looking up needs no join: the filters are literals of the plan.

Size: level 1 takes `bits_per_key` bits a listed key, and a cascade refuses more than `max_keys` of them before anything is
collected, so literals have a known bound; each later level encodes a small share of the one two before it. Rules beyond that bound
are looked up by joins instead, as no plan can hold their filters; the results are the same.

All cascades of a query are built from one pass over the corpus: what the first levels let through is written, and deeper levels read that.

Defined results: a null url, or one without "://", has an empty host and path; only A-Z of the host is lower-cased; a url with no
rule has rule null and the default verdict; very long urls are read whole; repeated rows are kept; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import small_enough, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


class Bloom:
    """A filter as 64-bit words; `k` positions from two halves of one hash."""

    def __init__(self, bits: int, k: int, seed: int):
        self.words, self.k, self.seed = max(1, -(-bits // 64)), k, seed
        self.data: list[int] = [0] * self.words

    def places(self, key: Column) -> list[Column]:
        h = F.xxhash64(key, F.lit(self.seed))
        low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
        return [F.pmod(low + high * F.lit(i), F.lit(64 * self.words)) for i in range(self.k)]

    def fill(self, keys: DataFrame) -> Bloom:
        """The words are or-ed by Spark; as many rows reach the driver as the filter has words, at most."""
        place = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("p"))
        bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
        for r in place.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).collect():
            self.data[r.w] = r.bits
        return self

    def has(self, key: Column) -> Column:
        words = F.array(*map(F.lit, self.data)) if self.words <= 64 else F.from_json(F.lit(str(self.data)), "array<bigint>")
        out = F.lit(True)
        for p in self.places(key):
            word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
            out = out & (word.bitwiseAND(_bit(p)) != 0)
        return out


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


class Cascade:
    """Exact membership of listed keys among every key that will be asked; deeper() adds the levels that the first one's errors call for."""

    def __init__(self, listed: DataFrame, bits_per_key: int = 10, max_keys: int = 1_000_000, most_levels: int = 32):
        self.listed = listed.select("key").distinct()
        n = self.listed.limit(max_keys + 1).count()
        if n > max_keys:
            raise ValueError(f"more than {max_keys} listed keys")
        self.bits_per_key, self.most_levels = bits_per_key, most_levels
        self.levels = [Bloom(bits_per_key * n, 5, 0).fill(self.listed)]

    def deeper(self, passed: DataFrame) -> Cascade:
        """passed (key): all keys of the universe that level 1 lets through, and maybe others."""
        wrong = passed.filter(self.levels[0].has(F.col("key"))).select("key").distinct().join(self.listed, "key", "left_anti")
        sides = [wrong, self.listed]
        while len(self.levels) < self.most_levels:
            side = len(self.levels) % 2 == 0  # whose keys the next level encodes: 0 wrong, 1 listed
            keys = sides[side]
            for level in self.levels[1 if not side else 0 :]:
                keys = keys.filter(level.has(F.col("key")))
            n = keys.count()
            if not n:
                return self
            self.levels.append(Bloom(max(64, self.bits_per_key * n), 5, len(self.levels)).fill(keys))
        raise RuntimeError("the cascade did not end")

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def cascades(lists: dict[str, DataFrame], universe: DataFrame, **sizes: int) -> dict[str, Cascade]:
    """lists of (key) by name; universe (key): every key that will be asked, repeats and listed ones included. It is read once."""
    found = {name: Cascade(keys, **sizes) for name, keys in lists.items()}
    any_level = reduce(Column.__or__, (c.levels[0].has(F.col("key")) for c in found.values()))
    # What level 1 lets through is the listed keys and few others; copies of a key are merged before the shuffle.
    passed = written(universe.filter(any_level).select("key").distinct(), "passed")
    return {name: c.deeper(passed) for name, c in found.items()}


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys host + path, longest first. Endings of the label counts, beginnings of the lengths that the rules have."""
    parts = F.split(host, r"\.", -1)
    keys = []
    for size, n, length in sorted(((n + length, n, length) for n in labels for length in lengths), reverse=True):
        ending = F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
        keys.append(F.when((F.size(parts) >= n) & (F.length(path) >= length) & (host != ""), F.concat(ending, F.substring(path, 1, length))))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def _rule_table(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table, made from a literal."""
    text = F.lit(json.dumps([{"verdict": v, "host": h, "path": p} for v, h, p in rules]))
    return pages.sparkSession.range(1).select(F.inline(F.from_json(text, "array<struct<verdict:string,host:string,path:string>>")))


def _sound(table: DataFrame) -> tuple[list[int], list[int]]:
    """Label counts and lengths that rules have; raises where rules are not sound."""
    key = F.concat("host", "path")
    bad = F.count_if(F.coalesce(F.contains("host", F.lit("/")) | ~F.startswith("path", F.lit("/")) | ~F.col("verdict").isin(*VERDICTS), F.lit(True)))
    shapes = table.groupBy(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("length")).agg(bad.alias("bad"), F.count("*").alias("n")).collect()
    if any(r.bad for r in shapes) or table.select(key.alias("key")).distinct().count() < sum(r.n for r in shapes):
        raise ValueError("rules need the verdict allow or block, hosts without a slash, paths that begin with one, and no repeats")
    return sorted({r.labels for r in shapes}), sorted({r.length for r in shapes})


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", max_keys: int = 1_000_000, **sizes: int) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict. rules: (verdict, host, path beginning), a list or a table; the longest that fits wins.

    A host and its path are one key, so no two rules may have the same; hosts have no slash and paths begin with one. Filters of at most
    max_keys rules are literals of the plan; more rules are looked up by joins, with the same result.
    """
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", "host", "path")
        labels, lengths = _sound(table)
        listed = lambda v: table.filter(F.col("verdict") == v).select(F.concat("host", "path").alias("key"))
        few = small_enough(table, max_keys)
        verdicts = [v for v in VERDICTS if few and not listed(v).isEmpty()]
    else:
        if any(v not in VERDICTS or "/" in h or not p.startswith("/") for v, h, p in rules) or len({h + p for _, h, p in rules}) < len(rules):
            raise ValueError("rules need the verdict allow or block, hosts without a slash, paths that begin with one, and no repeats")
        labels, lengths = sorted({h.count(".") + 1 for _, h, _ in rules}), sorted({len(p) for *_, p in rules})
        table = _rule_table(pages, rules)
        listed = lambda v: _rule_table(pages, [r for r in rules if r[0] == v]).select(F.concat("host", "path").alias("key"))
        few = len(rules) <= max_keys
        verdicts = [v for v in VERDICTS if any(x == v for x, *_ in rules)]
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = candidates(F.col("host"), F.col("path"), labels, lengths)
    if not few:
        return _joined(split, keys, table, default)
    lists = cascades({v: listed(v) for v in verdicts}, split.select(F.explode(keys).alias("key")), max_keys=max_keys, **sizes) if verdicts else {}
    judged = F.filter(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), _verdict(lists, k).alias("verdict"))), lambda x: x.verdict.isNotNull())
    best = F.try_element_at(F.array_sort(judged), F.lit(-1))
    return split.withColumn("best", best).select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _joined(split: DataFrame, keys: Column, rules: DataFrame, default: str, salts: int = 64) -> DataFrame:
    """The same by joins: different candidate keys meet the rules, and what is found meets the pages under salted keys, so no key is hot."""
    rows = written(split.withColumn("row", F.monotonically_increasing_id()), "pages")
    asked = rows.select("row", F.explode(keys).alias("rule"))
    found = written(asked.select("rule").distinct().join(rules.select(F.concat("host", "path").alias("rule"), F.col("verdict").alias("says")), "rule"), "found")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(salted, ["rule", "salt"])
    best = met.groupBy("row").agg(F.max_by(F.struct("rule", "says"), F.length("rule")).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"))


def _verdict(lists: dict[str, Cascade], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for verdict, cascade in lists.items():
        out = F.when(cascade.has(key), F.lit(verdict)).otherwise(out)
    return out
