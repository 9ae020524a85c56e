"""URL rules by a cascade of Bloom filters.

A list of keys is encoded against the complete set of keys that can be asked for
(the universe).  Level 1 is a Bloom filter of the listed keys.  The other keys of
the universe that it passes by error make level 2, the listed keys that level 2
passes by error make level 3, and so on until no error is left.  Whether a key of
the universe is listed is then exact: the first level that does not hold the key
decides.  Asking needs no join, only bits.  Everything is built of DataFrame
functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.session import staged

#: Bytes of one filter, which is sent along with the query; lists that need more are matched by an equi-join on the key.
MAX_BYTES = 16 << 20
#: Bytes of a filter that one row holds while it is built.
CHUNK = 4096


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    data: bytes


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed.  False for null."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            # Not in level n + 1 (from 1): an odd level denies, an even one confirms.
            answer = F.when(_in_level(self.levels[n], n, key), answer).otherwise(F.lit(n % 2 == 1))
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 1000 + i)), F.lit(bits)) for i in range(hashes)]


def _in_level(level: Level, n: int, key: Column) -> Column:
    data, found = F.lit(level.data), F.lit(True)
    for at in _positions(key, n, level.bits, level.hashes):
        octet = F.conv(F.hex(F.substring(data, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.call_function("shiftright", octet, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return found


def _level(keys: DataFrame, n: int, count: int, error: float) -> Level:
    """A Bloom filter of ``count`` keys that passes a share ``error`` of others.

    Bits are put together by byte, bytes by chunk, each in a shuffle; the chunks, whose number the caller has bounded, are
    put one behind the other.
    """
    bits = _bits(count, error)
    hashes = max(1, min(30, round(math.log2(1 / error))))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), n, bits, hashes))).alias("at"))
    octets = at.select(
        F.floor(F.col("at") / 8).cast("long").alias("o"),
        F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int")).alias("b"),
    ).union(keys.sparkSession.range(bits // 8).select(F.col("id").alias("o"), F.lit(0).alias("b"))).groupBy("o").agg(F.bit_or("b").alias("b"))
    chunks = octets.groupBy(F.floor(F.col("o") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("o", "b"))).alias("bytes"))
    packed = chunks.select("chunk", F.unhex(F.array_join(F.transform("bytes", lambda x: F.lpad(F.hex(x["b"]), 2, "0")), "")).alias("data"))
    return Level(bits, hashes, b"".join(bytes(r["data"]) for r in packed.orderBy("chunk").collect()))


def _bits(count: int, error: float) -> int:
    return 64 * max(1, math.ceil(count * math.log2(1 / error) / math.log(2) / 64))


def cascade(listed: DataFrame, universe: DataFrame, error: float = 1 / 16, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """Encode ``listed`` (``key``) against ``universe`` (``key``, distinct, a stored table).

    Listed keys outside the universe are left out: nothing can ask for them.
    Null keys are left out.  None if a level would need more than ``max_bytes``.
    Without listed keys the cascade has no level and holds nothing.
    """
    universe = universe.select("key").where("key is not null")
    inside = staged(universe.join(listed.select("key").distinct(), "key", "left_semi"), "listed")
    outside = staged(universe.join(inside, "key", "left_anti"), "listed")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    mine, count, other = inside, n_in, outside
    while count:
        # The first filter takes out most of the larger rest; the later ones halve what errors are left.
        rate = error if levels or not n_out else min(0.5, max(1e-9, math.sqrt(0.5) * n_in / n_out))
        if _bits(count, rate) > 8 * max_bytes:
            return None
        level = _level(mine, len(levels), count, rate)
        passed = staged(other.where(_in_level(level, len(levels), F.col("key"))), "passed")
        levels.append(level)
        mine, count, other = passed, passed.count(), mine
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty if the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def url_verdicts(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", keep: Iterable[str] = ("page_id",),
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per page: the columns ``keep``, ``host``, ``path``, ``rule`` (or null) and ``verdict``.

    ``rules`` are (action, host, path prefix).  The keys of a url are the ends of its host and the beginnings of its
    path of those lengths that rules have; a rule fits where its key is among them, the longest key wins, then the
    longer host.  Without a rule the verdict is ``allow``: the url is on no list.  Repeated and null urls give a row
    each; if a key has two actions, ``block`` wins.
    """
    spark, rules, keep = pages.sparkSession, list(dict.fromkeys(rules)), list(keep)
    host, path = url_parts(F.col(url_col))
    judged = pages.select(*keep, F.struct(host.alias("host"), path.alias("path")).alias("_at"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    h, p = F.col("_at.host"), F.col("_at.path")
    parts = F.size(F.split(h, r"\."))
    pieces = [
        (
            F.when((h != "") & (parts >= n), F.substring_index(h, ".", -n)),
            F.when(F.length(p) >= size, F.substring(p, 1, size)),
        )
        for n in labels
        for size in lengths
    ]
    keys = F.sort_array(
        F.filter(
            F.array(*[F.struct((-F.length(a) - F.length(b)).alias("l"), (-F.length(a)).alias("h"), F.concat(a, b).alias("key")) for a, b in pieces]),
            lambda k: k["key"].isNotNull(),
        )
    )
    judged = judged.withColumn("_keys", F.transform(keys, lambda k: k["key"]) if pieces else F.array().cast("array<string>"))
    universe = judged.select(F.explode("_keys").alias("key"))
    listed = {
        action: spark.createDataFrame([(a + b,) for act, a, b in rules if act == action], "key string")
        for action in ("block", "allow")
    }
    universe = staged(universe.distinct(), "universe")
    filters = {action: cascade(keys_of, universe, max_bytes=max_bytes) for action, keys_of in listed.items()}
    if None in filters.values():
        return _joined(judged, rules, keep)
    blocked, allowed = filters["block"], filters["allow"]
    hit = F.get(
        F.filter(
            F.transform(
                "_keys",
                lambda k: F.struct(
                    k.alias("rule"),
                    F.when(blocked.holds(k), "block").when(allowed.holds(k), "allow").alias("verdict"),
                ),
            ),
            lambda x: x["verdict"].isNotNull(),
        ),
        F.lit(0),
    )
    return judged.withColumn("_hit", hit).select(
        *keep, "_at.host", "_at.path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit("allow")).alias("verdict")
    )


def _joined(judged: DataFrame, rules: list[tuple[str, str, str]], keep: list[str]) -> DataFrame:
    """The same by an equi-join of distinct hosts and paths with the rules, for lists too long for filters."""
    spark = judged.sparkSession
    table = spark.createDataFrame([(h + p, a) for a, h, p in rules], "key string, action string")
    table = table.groupBy("key").agg(F.max("action").alias("action"))
    spots = judged.select("_at", "_keys").distinct()
    best = (
        spots.select("_at", F.posexplode("_keys").alias("rank", "key")).join(table, "key")
        .groupBy("_at").agg(F.min(F.struct("rank", "key", "action")).alias("best"))
    )
    return judged.join(best, "_at", "left").select(
        *keep, "_at.host", "_at.path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict")
    )
