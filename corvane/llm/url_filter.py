"""URL filters by a Bloom filter cascade (operator 9), in DataFrame functions only.

Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 takes for listed; level 3 the listed keys that
level 2 takes for such; and so on until a level errs on none. The key universe being known, the first level that doesn't
hold a key decides exactly, and a page needs no join: the levels are bit arrays in the plan. A level of more keys than one
array holds is dealt by a hash of the key to several.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (action, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A host of so many pages or more is listed: a corpus that is to be broad takes no further pages of it without a rule.
FLOOD = 10
#: Bits of one array; a level with more of them has several.
ARRAY_BITS = 1 << 29


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end; else empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits host or a domain above it and starts the path; nulls if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


class Cascade:
    """Levels of bit arrays over a universe of keys of which some are listed."""

    def __init__(self, keys: DataFrame, bits_per_key: float = 12.0, hashes: int = 5, array_bits: int = ARRAY_BITS):
        """keys: distinct (key string, listed boolean)."""
        self.levels: list[tuple[list[Column], int]] = []
        self.hashes = hashes
        rest = keys.where("listed")
        other = keys.where("not listed")
        made = []
        while n := rest.count():
            bits = max(64, 1 << math.ceil(math.log2(n * bits_per_key)))
            parts = max(1, bits // array_bits)
            level = len(self.levels)
            of = self._part(F.col("key"), level, parts)
            self.levels.append(([self._array(rest.where(of == p), level, bits // parts) for p in range(parts)], bits // parts))
            rest, other = C.spill(other.where(self._in(F.col("key"), level)), "cascade"), rest
            made.append(rest)
        C.discard(*made)

    def _part(self, key: Column, level: int, parts: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level), F.lit("part")), F.lit(parts).cast("long"))

    def _places(self, key: Column, level: int, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(self.hashes)]

    def _array(self, keys: DataFrame, level: int, bits: int) -> Column:
        """The array's 64-bit words: a table of one row, of at most ARRAY_BITS, whose value is put into plans."""
        spark = keys.sparkSession
        places = keys.select(F.explode(F.array(*self._places(F.col("key"), level, bits))).alias("at"))
        words = places.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("word"))
        dense = spark.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
        packed = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("words"))
        return C.spill(packed, "level").scalar()

    def _in(self, key: Column, level: int) -> Column:
        arrays, bits = self.levels[level]
        of = self._part(key, level, len(arrays))
        held = F.lit(False)
        for p, words in enumerate(arrays):
            mine = F.lit(True)
            for at in self._places(key, level, bits):
                word = F.element_at(words, F.shiftright(at, 6).cast("int") + 1)
                mine = mine & (F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
            held = mine if len(arrays) == 1 else F.when(of == p, mine).otherwise(held)
        return held

    def listed(self, key: Column) -> Column:
        """Whether the key, one of the universe, is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self._in(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def flooding(hosts: DataFrame, least: int = FLOOD) -> DataFrame:
    """(key, listed) of each host that hosts (host, a row for each page) holds; the empty host is never listed."""
    counts = hosts.groupBy(F.col("host").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("key", ((F.col("n") >= least) & (F.col("key") != "")).alias("listed"))


def judge(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, least: int = FLOOD) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url).

    The longest fitting rule's action, or without one: block if the host is listed, else allow. listed (host) is a table
    of hosts, in which nulls and repeats count for nothing; None lists the hosts of `least` pages or more. A url that is
    null or has no :// has neither host nor path, fits no rule and is allowed. Other columns of pages are not read.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    if listed is None:
        keys = flooding(base.select("host"), least)
    else:
        named = listed.select(F.col("host").cast("string").alias("key")).where("key <> ''").distinct().withColumn("listed", F.lit(True))
        keys = base.select(F.col("host").alias("key")).distinct().join(named, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    cascade = Cascade(C.spill(keys, "hosts"))
    rule, action = best_rule(F.col("host"), F.col("path"), rules)
    fallback = F.when(cascade.listed(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    return base.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, fallback).alias("verdict"))
