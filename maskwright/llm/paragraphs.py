"""Repeated passages by MinHash banding of paragraphs.

Paragraphs are lines; long lines are compared as a whole and in overlapping parts
that are cut where only nearby words decide.  Keys of two minima of the hashes of
their five-word shingles each (four keys) are joined, paragraphs that collide are
verified by the exact Jaccard similarity of their shingles, and connected
components of what is similar are the classes.  A passage may also be pasted into
the middle of a line: beside the paragraphs, windows of ``WINDOW`` words are
compared by their digest, of every ``WINNOW`` neighbouring ones that with the least
hash, so that texts which share ``WINDOW + WINNOW - 1`` words share a window.  A run
of neighbouring or overlapping units that an earlier document has too is removed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import fresh
from maskwright.llm.components import components
from maskwright.llm.periodic import split_words, text_bytes
from maskwright.session import drop_staged, measured, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s meets in a key with probability 1 - (1 - s**ROWS)**BANDS: 0.983 at 0.8.
BANDS, ROWS = 4, 2
#: Words of neighbouring repeated units from which they are a passage; what stands alone and is shorter is left in place.
MIN_RUN = 25
#: Words of a window, and neighbouring windows of which one is compared.  Of a shared passage of n words at least
#: n - 2 * (WINNOW - 1) are covered; what is not covered between two windows is bridged.
WINDOW, WINNOW = 10, 10
#: Words from which a line is compared in parts too; the reach of the minima between parts.
PARTS, WIDE = 128, 32
#: Different paragraphs of one key that one task compares; larger keys are compared block by block.
BLOCK = 1024
#: Bytes of text that are cut at a time.
PIECE = 2 << 20

_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A new 64-bit hash of hashes."""
    x = (x ^ np.uint64(salt * _ODD & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), _ODD, np.uint64)])


def _hash_cuts(h: np.ndarray, reach: int) -> np.ndarray:
    """Offsets after which a stretch of words is cut: where the hash of two neighbours is least within ``reach``."""
    pair = _mixed(h[:-1] + h[1:] * np.uint64(3), 7)
    if len(pair) <= 2 * reach:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(pair, 2 * reach + 1)
    return np.flatnonzero(windows.argmin(axis=1) == reach) + reach


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some texts one after the other (ASCII letters lower-cased), ends of lines, and words of
    each text."""
    data, ends = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    letters, lengths, sizes, before = split_words(data, ends)
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(letters)) - np.repeat(starts, lengths)
    coded = _mixed(np.arange(256, dtype=np.uint64), 5)[letters] * _powers(int(lengths.max(initial=0)))[inside]
    h = np.add.reduceat(coded, starts) if len(starts) else np.zeros(0, np.uint64)
    h = _mixed(h + lengths.astype(np.uint64), 17)
    lines = np.unique(np.r_[before[np.flatnonzero(data == 10)], np.cumsum(sizes)])
    return h, lines[lines > 0], sizes


def _digests(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Digests of stretches of words."""
    if not len(n):
        return np.zeros(0, np.uint64)
    number = np.repeat(np.arange(len(starts)), n)
    first = np.cumsum(n) - n
    inside = np.arange(len(number)) - first[number]
    return _mixed(np.add.reduceat(h[starts[number] + inside] * _powers(int(n.max()))[inside], first), 1)


def _shingles(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 32 bits of the shingles of stretches of ``SHINGLE`` words or more, with repeats, and their offsets."""
    five = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        five[: max(len(h) - k, 0)] += _mixed(h, 11 + k)[k:]
    five = _mixed(five, 2).astype(np.uint32).view(np.int32)
    size = n - (SHINGLE - 1)
    offsets = np.r_[0, np.cumsum(size)]
    return five[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], size)], offsets


def _parts(h: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the lines, those of more than ``PARTS`` words cut at hash minima."""
    begin = np.r_[0, lines[:-1]][: len(lines)]
    cuts = [lines]
    for s, e in zip(begin.tolist(), lines.tolist()):
        if e - s > PARTS:
            cuts.append(s + _hash_cuts(h[s:e], WIDE) + 1)
    edges = np.unique(np.concatenate(cuts))
    starts = np.r_[0, edges[:-1]][: len(edges)]
    return starts, edges - starts


def _paragraphs(h: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all lines, and of every two neighbouring parts of lines that are cut."""
    begin = np.r_[0, lines[:-1]][: len(lines)]
    starts, n = _parts(h, lines)
    line = np.searchsorted(lines, starts, side="right")
    pair = np.flatnonzero(line[:-1] == line[1:])
    return np.r_[begin, starts[pair]], np.r_[lines - begin, n[pair] + n[pair + 1]]


def _windows(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and digests of the windows with the least hash among every ``WINNOW`` neighbouring windows of a text."""
    m = len(h) - WINDOW + 1
    if m < WINNOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        value = value * np.uint64(_ODD) + h[k : k + m]
    value = _mixed(value, 3)
    text = np.repeat(np.arange(len(sizes)), sizes)
    around = np.lib.stride_tricks.sliding_window_view(value, WINNOW)
    within = text[: len(around)] == text[WINDOW + WINNOW - 2 :]
    chosen = np.unique((around.argmin(axis=1) + np.arange(len(around)))[within])
    return chosen, _mixed(value[chosen], 6)


def _placed(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text of each word, and the word's number in it."""
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, starts, side="right")
    return doc, starts - (ends - sizes)[doc]


def cut_paragraphs(texts: Iterable[str | None]) -> tuple[np.ndarray, ...]:
    """Of the lines of some texts, long ones cut in parts: text number, first word, words, digest, and shingles as offsets
    and hashes.

    Words are separated by ASCII white space and ASCII letters lower-cased.  A paragraph of fewer than five words has
    one shingle, itself; shingle hashes have 32 bits and may repeat.
    """
    h, lines, sizes = _read(pa.array(texts, pa.large_string()))
    starts, n = _parts(h, lines)
    digest, short = _digests(h, starts, n), n < SHINGLE
    value, ends = _shingles(h, starts[~short], n[~short])
    size = np.ones(len(n), np.int64)
    size[~short] = np.diff(ends)
    offsets = np.r_[0, np.cumsum(size)]
    out = np.empty(int(offsets[-1]), np.int32)
    out[offsets[:-1][short]] = digest[short].astype(np.uint32).view(np.int32)
    out[np.repeat(~short, size)] = value
    return *_placed(starts, sizes), n, digest.view(np.int64), offsets, out


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``PIECE`` bytes of text each."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy()
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
    for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def paragraph_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``digest, shingles``: the paragraphs of all texts that can be similar to a different one, shingles with repeats.

    Different sets of fewer than four shingles are less similar than 0.8: paragraphs of up to seven words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                h, lines, _ = _read(part.column(0))
                starts, n = _paragraphs(h, lines)
                starts, n = starts[n >= SHINGLE + 3], n[n >= SHINGLE + 3]
                digest, first = np.unique(_digests(h, starts, n), return_index=True)
                value, offsets = _shingles(h, starts[first], n[first])
                shingles = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), shingles], ["digest", "shingles"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "digest long, shingles array<int>")


def unit_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, hash, start, n, digest, again``: paragraphs and windows of all texts, with the text's hash, and whether the text
    has the digest before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                h, lines, sizes = _read(part.column(2))
                starts, n = _paragraphs(h, lines)
                digest = _digests(h, starts, n)
                more, window = _windows(h, sizes)
                starts, n, digest = np.r_[starts, more], np.r_[n, np.full(len(more), WINDOW)], np.r_[digest, window]
                order = np.argsort(starts, kind="stable")
                starts, n, digest = starts[order], n[order], digest[order]
                doc, start = _placed(starts, sizes)
                _, first = np.unique(_mixed(digest, 9) + doc.astype(np.uint64), return_index=True)
                again = np.ones(len(doc), bool)
                again[first] = False
                columns = [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc))]
                columns += [pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(digest.view(np.int64)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "start", "n", "digest", "again"])

    read = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("hash"), F.col(text_col).cast("string"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, hash int, start int, n int, digest long, again boolean")


def _band_keys(table: DataFrame) -> DataFrame:
    """``key, digest``: the keys of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, digest = batch.column(1), batch.column(0).to_numpy()
            if not len(digest):
                continue
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint32).astype(np.uint64)
            starts = (offsets - offsets[0])[:-1]
            keys = []
            for band in range(BANDS):
                least = [np.minimum.reduceat(_mixed(values, 100 + band * ROWS + r), starts) for r in range(ROWS)]
                key = least[0]
                for other in least[1:]:
                    key = _mixed(key, 5) + other
                keys.append(_mixed(key, 50 + band).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.tile(digest, BANDS))], ["key", "digest"]
            )

    return table.select("digest", "shingles").mapInArrow(run, "key long, digest long")


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between paragraphs that share a key and whose shingles are similar.

    ``members`` has ``key, left, right, whole, part, digest, shingles``; rows of a (key, left, right) are compared, two rows
    with ``whole`` or of one ``part`` not with each other.  Pairs that are connected already are not looked at again, so
    a group gives fewer links than it has members.
    """

    def links(whole: list[bool], component: list[int], digest: list[int], sets: list[frozenset]) -> Iterator[tuple[int, int]]:
        groups: dict[int, list[int]] = {}
        home: dict[int, int] = {}
        joined: dict[int, int] = {}
        for j, b in enumerate(sets):
            mine = home.setdefault(component[j], j)
            while mine in joined:
                mine = joined[mine]
            groups.setdefault(mine, [])
            least, most = similarity * len(b), len(b) / similarity
            for other in [g for g in groups if g != mine]:
                for i in groups[other]:
                    a = sets[i]
                    if least <= len(a) <= most and not (whole[i] and whole[j]):
                        both = len(a & b)
                        if both >= similarity * (len(a) + len(b) - both):
                            yield digest[i], digest[j]
                            groups[mine] += groups.pop(other)
                            joined[other] = mine
                            break
            groups[mine].append(j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: pa.Table) -> pa.RecordBatch:
            key, left, right = (part.column(k).to_numpy() for k in ("key", "left", "right"))
            whole, component, digest = (part.column(k).to_pylist() for k in ("whole", "part", "digest"))
            lists = part.column("shingles").combine_chunks()
            ends = lists.offsets.to_pylist()
            values = lists.values.to_pylist()
            sets = [frozenset(values[x:y]) for x, y in zip(ends, ends[1:])]
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0)) + 1
            out = []
            for s, e in zip(np.r_[0, new], np.r_[new, len(key)]):
                if e - s > 1:
                    out += links(whole[s:e], component[s:e], digest[s:e], sets[s:e])
            ab = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            names = ("key", "left", "right")
            final = [table.column(k)[-1] for k in names] if table.num_rows else []
            same = np.ones(table.num_rows, bool)
            for k, v in zip(names, final):
                same &= table.column(k).to_numpy() == v.as_py()
            first = int(same.argmax()) if table.num_rows else 0
            if first:
                yield found(table.slice(0, first))
            rest = table.slice(first)
        if rest is not None and rest.num_rows:
            yield found(rest)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["key", "left", "right", "whole", "part", "digest", "shingles"]
    grouped = members.select(*columns).repartition(n, "key", "left", "right").sortWithinPartitions("key", "left", "right", "digest")
    return grouped.mapInArrow(run, "a long, b long")


def _to_heads(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links of the paragraphs of each key to two of them, the one found most often and the one of least digest."""
    heads = members.join(sets.select("digest", "found"), "digest").groupBy("key").agg(
        F.array_distinct(F.array(F.max_by("digest", F.struct("found", "digest")), F.min("digest"))).alias("heads")
    )
    heads = heads.select("key", F.explode("heads").alias("head")).join(sets.select(F.col("digest").alias("head"), F.col("shingles").alias("theirs")), "head")
    pairs = members.join(sets.select("digest", "shingles"), "digest").join(heads, "key").where("digest <> head")
    both = F.size(F.array_intersect("shingles", "theirs"))
    enough = both >= F.lit(similarity) * (F.size("shingles") + F.size("theirs") - both)
    return pairs.where(enough).select(F.col("digest").alias("a"), F.col("head").alias("b")).distinct()


def _crowded_links(members: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """``a, b``: links in keys of more than ``block`` paragraphs.

    All are compared with two heads of their key.  What this connects in components needs no more comparisons inside them;
    the paragraphs outside the largest component of a key are compared, block by block, with all of the key.  If a key's
    paragraphs are variants of the most frequent one, that is linear.
    """
    first = staged(_to_heads(members, sets, similarity), "links")
    roots = components(first).select(F.col("node").alias("digest"), F.col("root"))
    placed = staged(members.join(roots, "digest", "left").select("key", "digest", F.coalesce("root", "digest").alias("part")), "members")
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    keys = parts.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"))
    keys = keys.where("most < all").select(
        "key", "largest", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("lefts"), F.ceil(F.col("all") / block).cast("int").alias("rights")
    )
    here = placed.join(keys, "key")
    at = F.xxhash64("digest")
    others = here.where("part <> largest").select(
        "key", F.pmod(at, F.col("lefts")).cast("int").alias("left"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("right"), F.lit(False).alias("whole"), "part", "digest"
    )
    everyone = here.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"), F.pmod(at, F.col("rights")).cast("int").alias("right"), F.lit(True).alias("whole"), "part", "digest"
    )
    rows = others.union(everyone).join(sets.select("digest", "shingles"), "digest")
    return first.union(_verified(rows, similarity))


def paragraph_links(table: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between digests of different paragraphs of at least ``similarity`` that meet in a band key.

    ``table`` is a stored paragraph table.  The keys of all paragraphs are shuffled once, summed up to their least and
    greatest digest before; only what collides is looked at again.
    """
    shared = staged(
        _band_keys(table).groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("key"), "shared"
    )
    members = staged(_band_keys(table).join(measured(shared), "key").distinct(), "members")
    digests = staged(members.select("digest").distinct(), "members")
    sets = staged(
        table.join(measured(digests), "digest", "left_semi")
        .groupBy("digest").agg(F.array_distinct(F.first("shingles")).alias("shingles"), F.count("*").alias("found")),
        "sets",
    )
    crowds = staged(members.groupBy("key").count().where(F.col("count") > block).select("key"), "crowds")
    few = members.join(crowds, "key", "left_anti").join(sets.select("digest", "shingles"), "digest").select(
        "key", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(False).alias("whole"), F.col("digest").alias("part"), "digest", "shingles"
    )
    links = _verified(few, similarity)
    if crowds.limit(1).count():
        links = links.union(_crowded_links(members.join(crowds, "key", "left_semi"), sets, similarity, block))
    return links.distinct()


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_run: int = MIN_RUN
) -> DataFrame:
    """``id, hash, start, n_words, n_paragraphs, first_id, removed``: the passages that several documents share.

    A document is an id with a text (its hash is ``hash``): rows that repeat both count as one, and rows without id
    stand behind those with one.  ``start`` counts words.  In the first document that has a paragraph of a class it is
    kept, in all later ones it is removed (``first_id`` is the least of those first documents); repeats inside one
    document stay.  Only runs of at least ``min_run`` words are listed;
    ``n_paragraphs`` counts the units in them, which may overlap.  Null and blank texts have no paragraphs.
    """
    table = staged(paragraph_table(docs, id_col, text_col), "paragraphs")
    roots = staged(components(paragraph_links(table, similarity)), "roots")
    drop_staged(table)
    table = staged(unit_table(docs, id_col, text_col), "units")
    # Digests of several texts first, by their number alone; then only their places are looked at.
    often = table.where("not again").groupBy("digest").count().where("count > 1").select("digest")
    wanted = staged(often.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "full_outer").select("digest", F.coalesce("root", "digest").alias("class")), "shared")
    who = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("hash").alias("hash"))
    places = staged(table.join(measured(wanted), "digest").select("id", "hash", "start", "n", "class"), "places")
    drop_staged(table)
    first = staged(places.groupBy("class").agg(F.min(who).alias("first"), F.max(who).alias("final")).where("first <> final").select("class", "first"), "classes")
    marked = (
        places.join(measured(first), "class")
        .select(who.alias("who"), "start", "n", "first", (F.col("first") < who).alias("removed")).distinct()
    )
    by_doc = Window.partitionBy("who", "removed").orderBy("start", "n", "first")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.col("n")).over(before)
    begins = F.coalesce(reach + max(WINNOW - WINDOW, 0) < F.col("start"), F.lit(True))
    runs = marked.withColumn("begins", begins.cast("int")).withColumn(
        "run", F.sum("begins").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        runs.groupBy("who", "removed", "run")
        .agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).cast("long").alias("n_words"), F.count("*").alias("n_paragraphs"), F.min("first").alias("first"))
        .where(F.col("n_words") >= min_run)
        .select(F.col("who.id").alias("id"), F.col("who.hash").alias("hash"), "start", "n_words", "n_paragraphs", F.col("first.id").alias("first_id"), "removed")
    )


def without_words(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text without the words first to last (excluded) of each span and the white space behind them."""
    gone = sorted(spans)
    out, at, n, pos = [], 0, 0, 0
    size = len(text)
    white = " \t\n\x0b\x0c\r"
    for first, end in gone:
        while pos < size and n < end:
            while pos < size and text[pos] in white:
                pos += 1
            if n == first:
                out.append(text[at:pos])
            while pos < size and text[pos] not in white:
                pos += 1
            n += 1
        while pos < size and text[pos] in white:
            pos += 1
        at = pos
    out.append(text[at:])
    return "".join(out)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts of all but the first document that has them.

    Every row stays, also if nothing but an empty text is left of it; other columns are not changed.
    """
    passages = repeated_passages(docs, id_col, text_col, **options).where("removed")
    no_id, id_, hash_, spans_ = fresh(docs.columns, "_no_id", "_id", "_hash", "_spans")
    spans = staged(
        passages.groupBy(F.col("id").isNull().alias(no_id), F.coalesce("id", F.lit(0)).alias(id_), F.col("hash").alias(hash_))
        .agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n_words")).cast("int").alias("end")))).alias(spans_)),
        "spans",
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_words(t, zip(s, e)) for t, s, e in zip(texts, starts, ends)], dtype=object)

    keyed = docs.withColumns({no_id: F.col(id_col).isNull(), id_: F.coalesce(id_col, F.lit(0)), hash_: F.hash(text_col)})
    joined = keyed.join(measured(spans), [no_id, id_, hash_], "left")
    shorter: Column = cut(F.col(text_col), F.col(f"{spans_}.start"), F.col(f"{spans_}.end"))
    return joined.withColumn(text_col, F.when(F.col(spans_).isNull(), F.col(text_col)).otherwise(shorter)).select(*docs.columns)
