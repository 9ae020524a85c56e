"""Near-duplicate documents by SimHash, found with Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into four segments of 16.  Of two fingerprints
that differ in at most three bits, either two segments are equal, or one is
equal and each other segment has exactly one error (pigeonhole).  The first case
needs plain keys of two segments.  For the second, a segment is taken as a word
of the perfect binary Golay code [23, 12, 7]: the index of its nearest codeword
is shared by most words around it, and the words at one bit from it have at most
six nearest codewords.  A word's own index is therefore always among the six
of any word at one bit's distance.  A key joins the equal segment with the
indices of two others, so that both sides give six keys each.  Candidates that
meet in a key are verified by counting bits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import fresh
from maskwright.llm.components import components
from maskwright.session import measured, staged

# The functions below travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Index entries of one key that are compared in pairs; keys with more take the linear way of ``_ball_links``.
PAIRED = 1024

# Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # in pieces: a bit takes a byte here
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of a text column: word shingles (ASCII letters lower-cased, repeats counted), a bit is set if it is
    set in over half of the shingles' XXH64. Null and blank texts give 0."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return run(text)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit segment: the index of its nearest codeword, and the indices of all words within one bit
    (padded with -1)."""
    syndromes = np.zeros(23, np.int64)
    for bit in range(23):
        r = 1 << bit
        for top in range(22, 10, -1):
            if r >> top & 1:
                r ^= GOLAY << (top - 11)
        syndromes[bit] = r
    error_of = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error_of[np.bitwise_xor.reduce(syndromes[list(bits)])] = sum(1 << b for b in bits)
    words = np.arange(1 << 16, dtype=np.int64)
    syndrome = np.zeros_like(words)
    for bit in range(16):
        syndrome ^= np.where(words >> bit & 1, syndromes[bit + 7], 0)
    index = ((words << 7) ^ error_of[syndrome]) >> 11
    around = np.stack([index] + [index[words ^ (1 << b)] for b in range(16)], axis=1)
    around.sort(axis=1)
    around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
    around.sort(axis=1)
    return index, around[:, -int((around >= 0).sum(axis=1).max()) :]


def _keys(prints: DataFrame, fp: str) -> DataFrame:
    """``fp, index_keys, probe_keys``; a key is a long: the combination in the upper bits, up to 40 bits below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, around = golay_tables()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            seg = [(values >> (16 * s)) & 0xFFFF for s in range(4)]
            plain = [
                (c << 40) | (seg[a] << 16) | seg[b] for c, (a, b) in enumerate(combinations(range(4), 2), start=1)
            ]
            sides = []
            for swap in (False, True):
                found = [p[:, None] for p in plain]
                for a in range(4):
                    j, k = ((a + 1) % 4, (a + 2) % 4)[:: -1 if swap else 1]
                    one, many = index[seg[j]], around[seg[k]]
                    pair = (one[:, None] << 12 | many) if not swap else (many << 12 | one[:, None])
                    key = ((8 + a) << 40) | (seg[a][:, None] << 24) | pair
                    found.append(np.where(many >= 0, key, -1))
                table = np.concatenate(found, axis=1)
                kept = table >= 0
                offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
                sides.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[kept])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], ["fp", "index_keys", "probe_keys"])

    return prints.select(F.col(fp).alias("fp")).mapInArrow(run, "fp long, index_keys array<long>, probe_keys array<long>")


def _ball_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links that join what lies within ``max_bits``, in a number that is linear in the rows.

    Two words are that close if some word is within the smaller half of one and
    the larger half of the other.  All that reach a word by the smaller half, and
    all that reach it by the larger half, are hung under one of the former.
    """
    near, far = max_bits // 2, max_bits - max_bits // 2

    def flips(radius: int) -> list[int]:
        return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]

    def masks(radius: int) -> Column:
        signed = np.array(flips(radius), dtype=np.uint64).view(np.int64)
        return F.from_json(F.lit(str(signed.tolist())), "array<long>")

    def ball(radius: int) -> DataFrame:
        return prints.select("fp", F.explode(masks(radius)).alias("mask")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word")
        )

    heads = measured(ball(near).groupBy("word").agg(F.min("fp").alias("head")), prints.count() * len(flips(near)))
    return ball(far).join(heads, "word").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()


def fingerprint_links(prints: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS, paired: int = PAIRED) -> DataFrame:
    """``a, b``: links between different fingerprints that connect exactly what lies within ``max_bits`` (0 to 3).

    Keys that up to ``paired`` fingerprints share give all their verified pairs.
    The fingerprints of larger keys are linked among themselves through balls
    instead: the same components, with links linear in their number.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    keys = _keys(prints.select(fp).distinct(), fp)
    index = keys.select(F.col("fp").alias("a"), F.explode("index_keys").alias("key"))
    probe = keys.select(F.col("fp").alias("b"), F.explode("probe_keys").alias("key"))
    crowded = staged(index.groupBy("key").count().where(F.col("count") > paired).select("key"), "crowded")
    balls = None
    if not crowded.isEmpty():
        inside = index.join(crowded, "key", "left_semi").select(F.col("a").alias("fp")).union(
            probe.join(crowded, "key", "left_semi").select("b")
        ).distinct()
        balls = _ball_links(staged(inside, "crowded"), max_bits)
        index = index.join(crowded, "key", "left_anti")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # Both sides have some thirty rows for each row by which Spark sizes them: small enough to be broadcast in its eyes only.
    probe = probe.hint("merge")
    links = index.join(probe, (index["key"] == probe["key"]) & (F.col("a") < F.col("b")) & close).select("a", "b")
    return (links if balls is None else links.union(balls)).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits), ``component_id``, ``text_hash``, ``root``
    (the group's least fingerprint as a number, which names it).

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` bits.  Null and blank texts have fingerprint 0 and link like any
    other.  Rows with a null id take part and get the id of their group, or null
    if no member has one.  Repeated rows are repeated in the result; other columns
    of ``docs`` are not read.  An empty table gives an empty result.
    """
    prints = staged(
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), fingerprint(F.col(text_col), shingle).alias("fp")
        ),
        "fingerprints",
    )
    roots = components(fingerprint_links(prints, "fp", max_bits))
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(of_root, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "text_hash",
        "root",
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` without near copies: of every group one row stays, that with the smallest id.

    Rows without id stand behind those with one; of rows that share the smallest id, the one with the least text
    hash and then the least row hash stays.  All columns are kept as they are.
    """
    groups = simhash_groups(docs, id_col, text_col, **options)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.coalesce(id_col, F.lit(0)).alias("id"), F.col("text_hash").alias("hash"))
    keepers = groups.groupBy("root").agg(F.min(order).alias("k")).select("k.*")
    no_id, id_, hash_, rank = fresh(docs.columns, "_no_id", "_id", "_hash", "_rank")
    keyed = docs.withColumns(
        {no_id: F.col(id_col).isNull(), id_: F.coalesce(id_col, F.lit(0)), hash_: F.xxhash64(text_col)}
    )
    kept = keyed.join(
        keepers,
        (keyed[no_id] == keepers["no_id"]) & (keyed[id_] == keepers["id"]) & (keyed[hash_] == keepers["hash"]),
        "left_semi",
    )
    first = Window.partitionBy(no_id, id_, hash_).orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)
