"""URL filters: allow and block lists as Bloom filter cascades, exact over the corpus's own keys.

Rules name a host and a path prefix (``example.org/en/``). The keys of a URL are its host or a
parent domain joined to a prefix of its path, for each pair of lengths that some rule has. All
keys of all pages are the universe. A cascade holds one list: level 1 encodes the listed keys,
level 2 the universe's keys that level 1 lets through by mistake, level 3 the listed keys that
level 2 lets through, and so on until a level makes no mistake. A key is listed if the first
level that rejects it is an even one. For every key of the universe that is exact, and a page is
judged by shifts and masks on constants, without a join.

The first level lets through about as many other keys as there are listed keys, the others half
of what they see. The bits of a list are at most about ``1.5 * n * log2(universe / n) + 6 * n``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweld.llm.common import longs
from tabweld.session import materialize

#: Listed keys of one cascade; its bits travel with the plan, so this bounds them (about 8 MB).
MOST_LISTED = 1 << 20


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, hash functions and the seed of the level."""

    words: tuple[int, ...]
    hashes: int
    seed: int


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower-cased) and path; both empty if the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def key_shapes(keys: Sequence[str]) -> list[tuple[int, int]]:
    """Lengths of host and path among the keys, longest key first, then longest host."""
    hosts = [k.partition("/")[0] for k in keys]
    return sorted({(len(h), len(k) - len(h)) for h, k in zip(hosts, keys)}, key=lambda s: (-s[0] - s[1], -s[0]))


def url_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The URL's key of each shape, null where it has none."""
    keys = []
    for h, p in shapes:
        same = F.length(host) == h
        below = (F.length(host) > h) & (F.substr(host, F.length(host) - F.lit(h), F.lit(1)) == ".")
        tail = F.right(host, F.lit(h)) if h else F.lit("")
        fits = (same | below) & (F.length(path) >= p)
        keys.append(F.when(fits, F.concat(tail, F.left(path, F.lit(p)) if p else F.lit(""))))
    return F.array(*keys) if keys else F.expr("cast(array() as array<string>)")


def bit_places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def in_level(key: Column, level: Level) -> Column:
    table, found = longs(list(level.words)), F.lit(True)
    for place in bit_places(key, 64 * len(level.words), level.hashes, level.seed):
        word = F.get(table, F.shiftright(place, 6).cast("int"))
        found = found & (F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
    return found


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter over the column ``key``: bits are or-ed by aggregation."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, 64 * math.ceil(1.4427 * math.log2(1 / rate) * n / 64))
    places = F.explode(F.array(*bit_places(F.col("key"), bits, hashes, seed))).alias("place")
    words = (
        keys.select(places)
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
        .collect()
    )
    filled = {r["word"]: r["bits"] for r in words}
    return Level(tuple(filled.get(w, 0) for w in range(bits // 64)), hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, universe_rows: int) -> list[Level]:
    """Levels for the distinct keys of ``listed`` against all keys of ``universe`` (column ``key``)."""
    listed = materialize(listed.where(F.col("key").isNotNull()).select("key").distinct(), "listed-keys")
    n = listed.count()
    if n > MOST_LISTED:
        raise ValueError(f"{n} listed keys; split the list into parts of at most {MOST_LISTED}")
    if not n:
        return []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    rate = min(0.5, n * math.sqrt(0.5) / max(1, universe_rows))
    levels: list[Level] = []
    while n:
        levels.append(build_level(inside, n, rate, len(levels)))
        let_through = materialize(outside.where(in_level(F.col("key"), levels[-1])), "cascade-level")
        inside, outside, n, rate = let_through, inside, let_through.count(), 0.5
    return levels


def is_listed(key: Column, cascade: Sequence[Level]) -> Column:
    """Whether a key of the universe is in the cascade's list; null keys are not."""
    answer: Column = F.lit(len(cascade) % 2 == 1)
    for k in reversed(range(len(cascade))):
        answer = F.when(in_level(key, cascade[k]), answer).otherwise(F.lit(k % 2 == 1))
    return F.coalesce(key.isNotNull() & answer, F.lit(False))


def judge_urls(
    pages: DataFrame,
    allow: Sequence[str],
    block: Sequence[str],
    otherwise: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    rule wins, at equal length the one with the longer host, and a rule on both lists blocks.
    URLs that no rule fits, null URLs and URLs without ``://`` get ``otherwise``.
    """
    spark: SparkSession = pages.sparkSession
    shapes = key_shapes([*allow, *block])
    host, path = split_url(F.col(url_column))
    parsed = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("keys", url_keys(F.col("host"), F.col("path"), shapes))
    universe = materialize(
        parsed.select(F.explode("keys").alias("key")).where("key is not null").distinct(), "url-keys"
    )
    size = universe.count()
    lists = {}
    for name, rules in (("allow", allow), ("block", block)):
        rows = spark.createDataFrame([(r,) for r in rules], "key string") if rules else spark.createDataFrame([], "key string")
        lists[name] = build_cascade(rows, universe, size)
    rule, verdict = F.lit(None).cast("string"), F.lit(otherwise)
    for i in reversed(range(len(shapes))):
        key = F.get("keys", F.lit(i))
        blocked, allowed = is_listed(key, lists["block"]), is_listed(key, lists["allow"])
        rule = F.when(blocked | allowed, key).otherwise(rule)
        verdict = F.when(blocked, F.lit("block")).when(allowed, F.lit("allow")).otherwise(verdict)
    return parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
