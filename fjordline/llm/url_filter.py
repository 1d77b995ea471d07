"""URL filter: host and path rules, then a Bloom filter cascade over the corpus's own keys.

The key universe is every distinct key (host + path) of the corpus, so the cascade can be made exact: level 0 encodes
the listed keys, level 1 the unlisted keys that level 0 lets through, level 2 the listed keys that level 1 lets through,
and so on until a level lets no key of the other class through. Judging a url is then a walk down the levels: no join of
keys. Each level is cut into segments of at most 16 KB; a key is hashed to one segment and to its bits there.

A walk reads the levels as scalar subqueries while their checked total is at most ``scalar_bytes``; beyond that each level's
segments are joined on the segment number (uniform by hash), so nothing of unbounded size is broadcast.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is never listed (allow);
repeated urls get the same verdict; an empty table or an empty list gives allow everywhere; other columns pass through, but for columns named host, path, rule, verdict and listed, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import written

SEGMENT_BITS = 1 << 17
#: One false positive in sixteen: few levels, under six bits a key.
BITS_PER_KEY, PROBES = 5.8, 4
SCALAR_BYTES = 32 << 20
MAX_LEVELS = 60

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = f"coalesce(locate('://', `{url}`), 0)"
    rest = f"substring(`{url}`, {at} + 3)"
    host = F.expr(f"if({at} = 0, '', translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'))")
    path = F.expr(f"if({at} = 0, '', regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1))")
    return host, path


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is host/path-prefix; it fits the host and its subdomains."""

    pattern: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, start = self.pattern.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)


def longest_rule(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, else nulls."""
    pattern = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = r.fits(host, path)
        pattern, verdict = F.when(fits, F.lit(r.pattern)).otherwise(pattern), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


@dataclass(frozen=True)
class Level:
    number: int
    segments: int
    bits: int
    table: DataFrame  # (segment, words): dense, one row a segment

    @property
    def bytes(self) -> int:
        return self.segments * self.bits // 8

    def segment(self, key: str) -> Column:
        return F.expr(f"cast(pmod(xxhash64({3 * self.number}, {key}), {self.segments}L) as int)")

    def places(self, key: str) -> list[Column]:
        a, b = (f"pmod(xxhash64({3 * self.number + i}, {key}), {self.bits}L)" for i in (1, 2))
        return [F.expr(f"cast(({a} + {i} * ({b} | 1L)) % {self.bits}L as int)") for i in range(PROBES)]

    def holds(self, key: str, words: Column) -> Column:
        out = F.lit(True)
        for p in self.places(key):
            out &= F.getbit(F.get(words, (p / 64).cast("int")), p % 64) == 1
        return out


def _encode(keys: DataFrame, number: int, n: int) -> Level:
    segments = max(1, math.ceil(n * BITS_PER_KEY / SEGMENT_BITS))
    bits = 64 * max(1, math.ceil(n * BITS_PER_KEY / segments / 64))
    level = Level(number, segments, bits, keys)
    words = bits // 64
    bit_rows = keys.select(level.segment("key").alias("segment"), F.explode(F.array(*level.places("key"))).alias("p")).select(
        "segment", F.expr("cast(floor(p / 64) as int)").alias("word"), F.expr("shiftleft(1L, p % 64)").alias("set")
    )
    zeros = keys.sparkSession.range(segments * words).select(
        F.expr(f"cast(floor(id / {words}) as int)").alias("segment"), F.expr(f"cast(id % {words} as int)").alias("word"), F.lit(0).cast("long").alias("set")
    )
    table = (
        bit_rows.union(zeros)
        .groupBy("segment", "word").agg(F.bit_or("set").alias("set"))
        .groupBy("segment").agg(F.expr("transform(array_sort(collect_list(struct(word, set))), x -> x.set)").alias("words"))
    )
    return Level(number, segments, bits, written(table, f"bloom{number}"))


def _with_words(rows: DataFrame, level: Level, key: str, scalar: bool) -> tuple[DataFrame, Column]:
    """``rows`` and the column of the words of each row's segment."""
    if scalar:
        whole = level.table.agg(F.expr("transform(array_sort(collect_list(struct(segment, words))), x -> x.words)").alias("w"))
        return rows, F.get(whole.scalar(), level.segment(key))
    table = level.table.select(F.col("segment").alias("__seg"), F.col("words").alias("__words"))
    return rows.withColumn("__at", level.segment(key)).join(table, F.col("__at") == F.col("__seg"), "left"), F.col("__words")


def _holds(rows: DataFrame, level: Level, key: str, into: str, scalar: bool) -> DataFrame:
    rows, words = _with_words(rows, level, key, scalar)
    # the same subquery stands in every probe and runs once; as a column of its own, its 16 KB would be copied into each row
    return rows.withColumn(into, F.coalesce(level.holds(key, words), F.lit(False))).drop("__at", "__seg", "__words")


def build_cascade(universe: DataFrame, scalar_bytes: int = SCALAR_BYTES) -> list[Level]:
    """``universe``: (key, listed), one row a key."""
    levels: list[Level] = []
    active = written(universe.select("key", "listed"), "universe")
    while len(levels) < MAX_LEVELS:
        own = F.col("listed") == F.lit(len(levels) % 2 == 0)
        n = active.where(own).count()
        if not n:
            return levels
        level = _encode(active.where(own), len(levels), n)
        levels.append(level)
        others = _holds(active.where(~own), level, "key", "__in", level.bytes <= scalar_bytes).where("__in").drop("__in")
        passed = written(others, "passed")
        if passed.isEmpty():
            return levels
        active = active.where(own).union(passed)
    raise ValueError(f"the cascade did not end within {MAX_LEVELS} levels")


def listed_by_cascade(rows: DataFrame, levels: list[Level], key: str = "key", into: str = "listed", scalar_bytes: int = SCALAR_BYTES) -> DataFrame:
    """Append whether each row's key is listed; exact for every key of the universe that the cascade was built on."""
    scalar = sum(x.bytes for x in levels) <= scalar_bytes
    for x in levels:
        rows = _holds(rows, x, key, f"__in{x.number}", scalar)
    member = F.lit(len(levels) % 2 == 1)
    for x in reversed(levels):
        member = F.when(~F.col(f"__in{x.number}"), F.lit(x.number % 2 == 1)).otherwise(member)
    return rows.withColumn(into, member).drop(*(f"__in{x.number}" for x in levels))


def judge_urls(pages: DataFrame, rules: list[UrlRule], is_listed: Column, url: str = "url", scalar_bytes: int = SCALAR_BYTES) -> DataFrame:
    """Append host, path, rule and verdict. ``is_listed`` marks the rows whose key (host + path) is on the block list."""
    host, path = host_and_path(url)
    rows = pages.withColumns({"host": host, "path": path, "__mark": F.coalesce(is_listed, F.lit(False))}).withColumn("__key", F.concat("host", "path"))
    universe = rows.where("host != ''").groupBy(F.col("__key").alias("key")).agg(F.max("__mark").alias("listed"))
    rows = listed_by_cascade(rows, build_cascade(universe, scalar_bytes), "__key", "__listed", scalar_bytes)
    rule, own = longest_rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("__listed") & (F.col("host") != ""), "block").otherwise("allow")
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(own, method), "listed": F.col("__listed") & (F.col("host") != "")}).drop("__mark", "__key", "__listed")
