"""Periodic runs of words, found in a grammar of the texts.

Word ids of the texts of a batch are compressed by Re-Pair: pairs of neighbours
that stand there twice or more become nonterminals, frequent ones first, until no
pair repeats.  A pass replaces every occurrence of a pair that no neighbouring
pair beats, so that the number of passes is small; pairs that are unique once stay
unique and are not looked at again.  What is left of a text gets a balanced tree.

A run lies inside some node of this derivation and across the boundary of its two
halves.  So the runs across the boundary of each nonterminal are worked out once,
at its first place, then moved to all places where it is derived, and intervals
of one period that overlap by a period or more are merged.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import fresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run has at least so many words, and so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words of the grams that must recur at a period's distance beside a boundary.  A run across a boundary has at least
#: MIN_WORDS * (1 - 1 / MIN_PERIODS) neighbouring words that recur so, and half of them on one side.
GRAM = MIN_WORDS * (MIN_PERIODS - 1) // MIN_PERIODS // 2
#: Bytes of text whose grammar is made at a time (a longer text has one of its own).
PIECE = 2 << 20


def split_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words of some texts that follow each other: their bytes without what separates them, the bytes of each word,
    the words of each text, and the words that begin before each byte."""
    letter = (data != 32) & ((data < 9) | (data > 13))
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    starts = np.r_[0, ends[:-1]]
    starts = starts[starts < len(data)]
    begins[starts] = letter[starts]
    before = np.r_[0, np.cumsum(begins)]
    number = before[1:][letter] - 1
    return data[letter], np.bincount(number, minlength=int(before[-1])), np.diff(before[np.r_[0, ends]]), before


def word_ids(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    offsets = pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(np.ascontiguousarray(letters))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


class Node:
    """Nodes of derivations of at least ``MIN_WORDS`` words, as columns: the first place, the place of the boundary and
    the end of each, and all places by the number of the node."""

    def __init__(self) -> None:
        self.low: list[np.ndarray] = []
        self.middle: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.node: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.n = 0

    def add(self, low: np.ndarray, middle: np.ndarray, high: np.ndarray, node: np.ndarray, place: np.ndarray) -> None:
        self.low.append(low)
        self.middle.append(middle)
        self.high.append(high)
        self.node.append(node + self.n)
        self.place.append(place)
        self.n += len(low)

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, np.int64), *part]) for part in (self.low, self.middle, self.high, self.node, self.place)]


def _passes(ids: np.ndarray, text: np.ndarray, nodes: Node) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: adds nonterminals to ``nodes`` and gives places and sizes of the symbols that are left."""
    n = len(ids)
    symbol, place, size = ids, np.arange(n), np.ones(n, np.int64)
    joined = np.r_[text[:-1] == text[1:], False] if n else np.zeros(0, bool)  # to the symbol behind
    total = int(ids.max(initial=-1)) + 1
    done_place, done_size = [], []
    while True:
        at = np.flatnonzero(joined)
        order_key = symbol[at] * total + symbol[at + 1]
        pairs, inverse, counts = np.unique(order_key, return_inverse=True, return_counts=True)
        live = counts[inverse] > 1
        joined[at[~live]] = False
        at, inverse = at[live], inverse[live]
        alone = ~joined
        alone[1:] &= ~joined[:-1]
        done_place.append(place[alone])
        done_size.append(size[alone])
        if not len(at):
            break
        # Rank pairs by count; an occurrence is replaced where both neighbouring occurrences have later ranks, and in
        # stretches of one pair (a a a ...) every other one is.
        rank_of = np.empty(len(pairs), np.int64)
        rank_of[np.lexsort((pairs, -counts))] = np.arange(len(pairs))
        rank = np.full(len(symbol) + 1, len(pairs), np.int64)
        rank[at] = rank_of[inverse]
        mine, before, behind = rank[at], np.where(at > 0, rank[at - 1], len(pairs)), rank[at + 1]
        first = np.flatnonzero(before != mine)
        stretch = np.repeat(first, np.diff(np.r_[first, len(at)]))
        chosen = ((np.arange(len(at)) - stretch) % 2 == 0) & (before >= mine) & (behind >= mine)
        at, made = at[chosen], inverse[chosen]
        _, where, node = np.unique(made, return_index=True, return_inverse=True)
        whole = size[at] + size[at + 1]
        long = np.flatnonzero(whole[where] >= MIN_WORDS)
        if len(long):
            number = np.full(len(where), -1, np.int64)
            number[long] = np.arange(len(long))
            sample = at[where[long]]
            kept = np.flatnonzero(number[node] >= 0)
            nodes.add(
                place[sample], place[sample] + size[sample], place[sample] + size[sample] + size[sample + 1],
                number[node[kept]], place[at[kept]],
            )
        symbol, joined = symbol.copy(), joined.copy()
        symbol[at], size = total + node, size.copy()
        size[at] = whole
        joined[at] = joined[at + 1]
        total += len(where)
        gone = np.zeros(len(symbol), bool)
        gone[at + 1] = True
        gone |= alone
        rest = ~gone
        symbol, place, size, joined = symbol[rest], place[rest], size[rest], joined[rest]
    done_place, done_size = np.concatenate(done_place), np.concatenate(done_size)
    order = np.argsort(done_place, kind="stable")
    return done_place[order], done_size[order]


def derivation(ids: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """First place, boundary and end of every long node, and numbers and places of all their occurrences.

    ``ids`` are the words of some texts one after the other, ``text`` the number of each word's text."""
    nodes = Node()
    place, size = _passes(ids, text, nodes)
    while len(place):
        owner = text[place]
        start = np.r_[True, owner[1:] != owner[:-1]]
        first = np.flatnonzero(start)
        inside = np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))
        left = np.flatnonzero((inside[:-1] % 2 == 0) & ~start[1:])
        if not len(left):
            break
        whole = size[left] + size[left + 1]
        long = left[whole >= MIN_WORDS]
        end = place[long] + size[long] + size[long + 1]
        nodes.add(place[long], place[long] + size[long], end, np.arange(len(long)), place[long])
        size = size.copy()
        size[left] = whole
        rest = np.ones(len(place), bool)
        rest[left + 1] = False
        place, size = place[rest], size[rest]
    return nodes.columns()


def _grams(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the grams that recur, sorted by gram and place; the slot of every place among them (-1: does not recur);
    and where each slot's gram ends."""
    n = len(ids) - GRAM + 1
    slot = np.full(max(len(ids), 1), -1, np.int64)
    if n <= 0:
        return np.zeros(0, np.int64), slot, np.zeros(0, np.int64)
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = value * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    value ^= value >> np.uint64(32)
    value = value * np.uint64(0x94D049BB133111EB) + text[:n].astype(np.uint64)
    bucket = (value >> np.uint64(40)).astype(np.int64)
    usable = text[:n] == text[GRAM - 1 :]
    often = np.bincount(bucket[usable], minlength=1 << 24)[bucket] > 1 if n > 1 << 16 else np.ones(n, bool)
    at = np.flatnonzero(usable & often)
    at = at[np.argsort(value[at], kind="stable")]
    v = value[at]
    same = np.r_[v[1:] == v[:-1], False]
    keep = same.copy()
    keep[1:] |= same[:-1]
    at, v = at[keep], v[keep]
    slot[at] = np.arange(len(at))
    edge = np.flatnonzero(np.r_[v[1:] != v[:-1], True]) + 1 if len(v) else np.zeros(0, np.int64)
    return at, slot, np.repeat(edge, np.diff(np.r_[0, edge]))


def _extend(ids: np.ndarray, i: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch with period ``q`` in ``low`` to ``high`` around the places ``i`` and ``i + q``."""
    end, step = i, 32
    while end < high - q:
        to = min(end + step, high - q)
        same = ids[end:to] == ids[end + q : to + q]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = to, step * 2
    start, step = i, 32
    while start > low:
        to = max(start - step, low)
        same = ids[to:start] == ids[to + q : start + q]
        if not same.all():
            start -= int(same[::-1].argmin())
            break
        start, step = to, step * 2
    return start, end + q


def _crossing(ids: np.ndarray, low: int, middle: int, high: int, at: np.ndarray, slot: np.ndarray, edge: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs across ``middle`` inside ``low`` to ``high``: start, end and smallest period.

    For a period q, the places where words recur after q words are a stretch of two periods or more; it covers the
    boundary or the place q words before it, and a whole gram on one side of that.
    """
    longest = (high - low) // MIN_PERIODS
    found: dict[tuple[int, int], int] = {}
    for anchor in (middle, middle - GRAM):
        s = int(slot[anchor]) if low <= anchor <= high - GRAM else -1
        if s < 0:
            continue
        for step in (1, -1):
            k, inside = s + step, None
            while 0 <= k < len(at) and edge[k] == edge[s]:
                other = int(at[k])
                q = (other - anchor) * step
                if q > longest or not low <= other <= high - GRAM:
                    break
                if inside is not None and q % inside[2] == 0 and inside[0] <= other and other + GRAM <= inside[1]:
                    # In a run whose period divides this distance: nothing new; with a period up to the gram's length
                    # nothing new before the run's end either.
                    k += step
                    if inside[2] <= GRAM:
                        limit = inside[1] - GRAM if step > 0 else inside[0]
                        if step > 0:
                            k = max(k, s + int(np.searchsorted(at[s : edge[s]], limit, side="right")))
                        else:
                            begin = int(np.searchsorted(edge, edge[s], side="left"))
                            k = min(k, begin + int(np.searchsorted(at[begin:s], limit, side="left")) - 1)
                    continue
                i = middle if step > 0 else middle - q
                if i >= low and i + q <= high:
                    start, end = _extend(ids, i, q, low, high)
                    if end - start >= max(MIN_WORDS, MIN_PERIODS * q):
                        found[start, end] = min(q, found.get((start, end), q))
                        if inside is None or start < inside[0] or end > inside[1]:
                            inside = (start, end, q)
                k += step
    return [(s, e, q) for (s, e), q in found.items() if not any(p < q and q % p == 0 and a <= s and e <= b for (a, b), p in found.items())]


def find_runs(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """All runs of some texts: rows of start, end and period, by start and period."""
    low, middle, high, node, place = derivation(ids, text)
    at, slot, edge = _grams(ids, text)
    # A boundary with a run has a gram beside it that recurs near enough inside the node.
    near = np.zeros(len(low), bool)
    if len(at):
        ahead = np.full(len(at), 1 << 62)
        ahead[:-1] = np.where(edge[1:] == edge[:-1], at[1:] - at[:-1], 1 << 62)
        behind = np.r_[1 << 62, ahead[:-1]]
        longest = (high - low) // MIN_PERIODS
        for anchor in (middle, middle - GRAM):
            fits = (anchor >= low) & (anchor <= high - GRAM)
            s = np.where(fits, slot[np.where(fits, anchor, 0)], -1)
            fits &= s >= 0
            near |= fits & ((ahead[s] <= np.minimum(longest, high - GRAM - anchor)) | (behind[s] <= np.minimum(longest, anchor - low)))
    runs: list[np.ndarray] = []
    by_node = np.argsort(node, kind="stable")
    bounds = np.searchsorted(node[by_node], np.arange(len(low) + 1))
    for k in np.flatnonzero(near).tolist():
        mine = _crossing(ids, int(low[k]), int(middle[k]), int(high[k]), at, slot, edge)
        if mine:
            moved = place[by_node[bounds[k] : bounds[k + 1]]] - low[k]
            block = np.array(mine, np.int64)
            rows = np.tile(block, (len(moved), 1))
            rows[:, :2] += np.repeat(moved, len(block))[:, None]
            runs.append(rows)
    if not runs:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(runs), axis=0)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0], rows[:, 2]))]
    start, end, period = rows.T
    # Merge by period: an interval goes on while the next one overlaps it by a period or more (texts are apart, so that
    # the furthest end of a period can be taken over all texts before it).
    shift = period * (int(end.max()) + 1)
    reach = np.r_[-1, np.maximum.accumulate(end + shift)[:-1]]
    new = (np.r_[-1, period[:-1]] != period) | (reach - period < start + shift)
    first = np.flatnonzero(new)
    merged = np.column_stack([start[first], np.maximum.reduceat(end, first), period[first]])
    return merged[np.lexsort((merged[:, 2], merged[:, 0]))]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of a column, and where each ends; null texts are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _described(column: pa.Array) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs of every text (start, words, period), and the texts without the repeats."""
    data, ends = text_bytes(column)
    letters, sizes, words, _ = split_words(data, ends)
    text = np.repeat(np.arange(len(words)), words)
    first = np.cumsum(words) - words
    rows = find_runs(word_ids(letters, sizes), text)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    kept = np.ones(len(sizes), bool)
    for start, end, period in rows.tolist():
        owner = int(text[start])
        runs[owner].append((start - int(first[owner]), end - start, period))
        kept[start + period : end] = False
    letter_kept = np.repeat(kept, sizes)
    rank = np.cumsum(kept) - 1
    joined = np.full(int(letter_kept.sum() + kept.sum()), 32, np.uint8)
    joined[np.arange(int(letter_kept.sum())) + np.repeat(rank[kept], sizes[kept])] = letters[letter_kept]
    before = np.r_[0, np.cumsum(np.where(kept, sizes + 1, 0))]
    begin, end = before[first], before[first + words]
    whole = joined.tobytes()
    return runs, [whole[b : max(e - 1, b)] for b, e in zip(begin.tolist(), end.tolist())]


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str | Column = "text") -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, ``runs``, ``collapsed``.

    Words are separated by ASCII white space and compared exactly.  ``runs`` holds every run, by start, then period: a
    stretch of ``length`` words from word ``start`` with the smallest ``period`` (words so far apart are equal), of
    ``MIN_WORDS`` words and ``MIN_PERIODS`` periods or more, that cannot be extended.  ``collapsed`` is the text, its words
    joined by one space, without the words that a run contains behind its first period.  Null, empty and blank texts
    have no runs and collapse to an empty text; a text is judged by itself, so ties and repeated rows give equal results;
    an empty table gives an empty result; of other columns only ``keep`` is taken.  A text of any length is one piece:
    memory grows with it linearly.  A narrow job: no shuffle.
    """
    n = len(keep)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(n)).fill_null(0).to_numpy()
            edges = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
            for begin, end in zip(np.r_[0, edges].tolist(), [*edges.tolist(), batch.num_rows]):
                if end > begin:
                    part = batch.slice(begin, end - begin)
                    runs, collapsed = _described(part.column(n))
                    named = [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs]
                    columns = [*[part.column(i) for i in range(n)], pa.array(named, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "runs", "collapsed"])

    (text,) = fresh(keep, "text")
    value = F.col(text_col) if isinstance(text_col, str) else text_col
    read = docs.select(*keep, value.cast("string").alias(text))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return read.mapInArrow(run, f"{kept}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
