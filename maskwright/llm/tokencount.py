"""Token counts by a compiled finite-state transducer for a sentencepiece BPE model.

The machine reads a text character by character, and every transition says by
how many the number of tokens changes.  What a state has to remember follows
from how BPE behaves: a sequence of tokens is the encoding of its text exactly
if each two neighbours are the encoding of their own text.  So the last token of
a prefix is the one token ending there that agrees with the last token of the
prefix before it, and a state keeps, for every suffix that may still grow into a
token, the last token before that suffix and how many tokens lie before it.
There are finitely many such states; they are made when a text first needs them
and interned, as all of them together would be far too many.

Texts are cut into chunks, and all chunks of a batch are read side by side.  A
chunk is read from a state that knows nothing; two characters that no token holds
side by side make the state known, whatever was before.  The state map of a
chunk is therefore a head, which needs the state before it, and from there on a
constant.  Composing maps of neighbours reads the heads from the states before
them, again side by side; a prefix sum over the chunks of a text gives the counts
of its prefixes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a chunk, and of all chunks that are read side by side.
CHUNK, SIDE_BY_SIDE = 1 << 8, 1 << 20
#: Bytes of the transition table and agreements of tokens that a worker keeps before it starts again with none.
TABLE_BYTES, AGREEMENTS = 256 << 20, 400_000
#: Chunks from which reading them side by side is faster than one by one.
FEW = 12

_SPACE = "\u2581"


class Model:
    """What the compiler needs of a model: scores of pieces, and the character put before every text.

    The machine made of it stays with the model, so that all tasks of a worker share what is compiled.
    """

    def __init__(self, scores: dict[str, float], prefix: str) -> None:
        self.scores, self.prefix = scores, prefix
        self.made: Machine | None = None

    def machine(self) -> Machine:
        if self.made is None:
            self.made = Machine(self.scores)
        return self.made


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> Model:
    """Pieces of a sentencepiece model file.

    Raises ``ValueError`` for what the machine does not know: models that are not BPE or lack the fallback to bytes,
    normalisers that change more than spaces, and pieces given by the user or taken out of use.
    """
    with open(path, "rb") as file:
        data = file.read()
    # Field numbers of sentencepiece's model format, and their defaults.
    trainer = {3: 1, 24: 0, 35: 0}
    normaliser = {2: b"", 3: 1, 4: 1, 5: 1}
    kinds = set()
    for field, value in _fields(data):
        if field == 1:
            kinds.add(dict(_fields(value)).get(3, 1))
        elif field == 2:
            trainer |= dict(_fields(value))
        elif field == 3:
            normaliser |= dict(_fields(value))
    known = trainer[3] == 2 and trainer[35] == 1 and not trainer[24] and not kinds & {4, 5}
    if not known or normaliser[2] or normaliser[4] or not normaliser[5]:
        raise ValueError("only BPE with byte fallback, plain pieces and no normalisation can be compiled")
    pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
    plain = [i for i in range(pieces.get_piece_size()) if not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i))]
    return Model({pieces.id_to_piece(i): pieces.get_score(i) for i in plain}, _SPACE if normaliser[3] else "")


class Machine:
    """The transducer of some scored pieces, compiled as far as texts have needed it.

    The key of a known state is a tuple of ``(suffix, token, tokens)``: a suffix of what was read that is the beginning of
    a longer token, the last token before it (None where any token agrees), and the tokens before it, less those of all
    that was read.  The empty suffix comes first.  The key of a state that is not known is the last character.  A state
    also has the change of the count on the way into it (``emit``).

    Characters that no longer piece holds behave alike if they have as many tokens: they share a class.
    """

    def __init__(self, scores: dict[str, float], table_bytes: int = TABLE_BYTES) -> None:
        self.scores = scores
        self.beginnings = {p[:k] for p in scores for k in range(1, len(p))}
        self.inside = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        self.best: dict[str, float] = {}  # of all pieces that begin so
        for piece, score in scores.items():
            for k in range(2, len(piece) + 1):
                if score > self.best.get(piece[:k], -np.inf):
                    self.best[piece[:k]] = score
        joined = sorted({c for pair in self.inside for c in pair})
        alone = sorted({p for p in scores if len(p) == 1} - set(joined))
        taken = set(joined) | set(alone)
        self.codes = np.zeros(0x110000, np.uint16)
        self.chars: list[str] = []
        for first, end in ((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000)):
            self.codes[first:end] = len(self.chars)
            self.chars.append(next((chr(c) for c in range(first, end) if chr(c) not in taken and not 0xD800 <= c < 0xE000), ""))
        self.codes[[ord(c) for c in alone]] = len(self.chars)
        self.chars.append(alone[0] if alone else "")
        self.codes[[ord(c) for c in joined]] = np.arange(len(joined)) + len(self.chars)
        self.chars += joined
        self.sizes = [1 if c in scores else len(c.encode()) for c in self.chars]
        self.limit = max(table_bytes // (4 * len(self.chars)), 16)
        self.spines: dict[str, tuple] = {}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.ruled: dict[tuple[str, str], bool] = {}
        self._empty()

    def _empty(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple | str] = []
        self.table = np.zeros((0, len(self.chars)), np.int32)
        self.emit, self.known = np.zeros(0, np.int32), np.zeros(0, bool)
        self.begin = self.state((("", None, 0),), 0)  # before a text, and behind a place that no token spans
        self.unknown = self.state("", 0)  # before a chunk

    def state(self, key: tuple | str, emit: int) -> int:
        found = self.ids.get((key, emit))
        if found is None:
            found = self.ids[key, emit] = len(self.keys)
            self.keys.append(key)
            if found == len(self.table):
                more = max(found, 1024)
                self.table = np.concatenate([self.table, np.full((more, len(self.chars)), -1, np.int32)])
                self.emit, self.known = np.resize(self.emit, found + more), np.resize(self.known, found + more)
            self.emit[found], self.known[found] = emit, not isinstance(key, str)
        return found

    def restart(self, *held: np.ndarray) -> None:
        """Forget all states but those in some arrays, which get their new numbers."""
        keys = self.keys
        self._empty()
        for states in held:
            old, at = np.unique(states, return_inverse=True)
            states[:] = np.array([self.state(keys[s], 0) for s in old.tolist()], np.int64)[at]

    def encode(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """BPE of a short text (the best score first, the leftmost of equals), and for every merge its score and the first
        and the last part behind it."""
        parts, scores, merges = list(text), self.scores, []
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts, merges
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            merges.append((best, parts[0], parts[-1]))

    def spine(self, token: str) -> tuple[bool, list]:
        """Whether a token is the encoding of its own text, and its merges."""
        found = self.spines.get(token)
        if found is None:
            parts, merges = self.encode(token)
            found = self.spines[token] = (parts == [token], merges)
        return found

    def agree(self, before: str | None, token: str) -> bool:
        """Whether a token stands behind another one (or behind anything) in an encoding."""
        whole, right = self.spine(token)
        if before is None or not whole:
            return whole
        found = self.agreed.get((before, token))
        if found is None:
            if len(self.agreed) >= AGREEMENTS:
                self.agreed.clear()
            found = self.agreed[before, token] = self._apart(before, self.spine(before)[1], token, right)
        return found

    def matters(self, before: str, char: str) -> bool:
        """Whether a token that begins with a character may not agree with the token before it."""
        found = self.ruled.get((before, char))
        if found is None:
            if len(self.ruled) >= AGREEMENTS:
                self.ruled.clear()
            merges = self.spine(before)[1]
            last = [before[-1], *[m[2] for m in merges]]
            until = [*[m[0] for m in merges], -np.inf]
            found = self.ruled[before, char] = any(self.best.get(a + char, -np.inf) > s for a, s in zip(last, until))
        return found

    def _apart(self, before: str, left: list, token: str, right: list) -> bool:
        """Follow the merges of two neighbouring tokens in their common order: whether none joins them."""
        a, b, i, j = before[-1], token[0], 0, 0
        get = self.scores.get
        while True:
            across = get(a + b)
            in_left = left[i][0] if i < len(left) else None
            in_right = right[j][0] if j < len(right) else None
            if across is not None and (in_left is None or across > in_left) and (in_right is None or across >= in_right):
                return False
            if in_left is not None and (in_right is None or in_left >= in_right):
                a, i = left[i][2], i + 1
            elif in_right is not None:
                b, j = right[j][1], j + 1
            else:
                return True

    def step(self, state: int, code: int) -> int:
        """Compile a transition."""
        key, char = self.keys[state], self.chars[code]
        if isinstance(key, str):
            if not key or key + char in self.inside:
                target = self.table[state, code] = self.state(char, 0)
                return int(target)
            key = self.keys[self.begin]
        last, emit, grown = None, 0, []
        for suffix, token, tokens in key:
            if token is not None and not suffix and not self.matters(token, char):
                token = None
            longer = suffix + char
            if last is None and (not suffix or longer in self.scores) and self.agree(token, longer):
                last = longer
                emit = tokens + (1 if suffix else self.sizes[code])
            if longer in self.beginnings:
                grown.append((longer, token, tokens))
        target = self.state((("", last, 0), *[(suffix, token, tokens - emit) for suffix, token, tokens in grown]), emit)
        self.table[state, code] = target
        return target

    def read(self, states: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, held: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, ...]:
        """Read stretches of ``codes`` from some states, side by side: the states behind them, the changes of the count,
        and the characters read before the state was known.  States in ``held`` stay valid."""
        if len(starts) < FEW:
            return self._read_each(states, codes, starts, sizes, held)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, state = starts[order], sizes[order], states[order].astype(np.int64)
        count, head = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for t, n in enumerate(active.tolist()):
            now, code = state[:n], codes[starts[:n] + t]
            target = self.table[now, code]
            missing = np.flatnonzero(target < 0)
            if len(missing):
                if len(self.keys) > self.limit:
                    self.restart(state, *held)
                    now, missing = state[:n], np.arange(n)
                for i in missing.tolist():
                    known = self.table[now[i], code[i]]
                    target[i] = known if known >= 0 else self.step(int(now[i]), int(code[i]))
            count[:n] += self.emit[target]
            head[:n] += ~self.known[target]
            state[:n] = target
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back], head[back]

    def _read_each(self, states: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, held: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
        state, count, head = states.astype(np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for i, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
            if len(self.keys) > self.limit:
                self.restart(state, *held)
            now = int(state[i])
            for code in codes[s : s + n].tolist():
                target = int(self.table[now, code])
                now = target if target >= 0 else self.step(now, code)
                count[i] += self.emit[now]
                head[i] += not self.known[now]
            state[i] = now
        return state, count, head


def count_texts(machine: Machine, texts: Sequence[str | None], prefix: str, chunk: int = CHUNK) -> list[np.ndarray]:
    """For every text the token counts of its prefixes of one, two, ... chunks; the last is that of the whole text."""
    whole = "".join([prefix + t if t else "" for t in texts]).replace(" ", _SPACE)
    codes = machine.codes[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    length = np.array([len(prefix) + len(t) if t else 0 for t in texts], np.int64)
    chunks = np.maximum(-(-length // chunk), 1)
    first = np.cumsum(chunks) - chunks
    number = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
    starts = np.repeat(np.cumsum(length) - length, chunks) + number * chunk
    sizes = np.minimum(np.repeat(length, chunks) - number * chunk, chunk)
    state, count, head = machine.read(np.where(number == 0, machine.begin, machine.unknown), codes, starts, sizes)
    # Compose: a head is read from the state before it as soon as that is known.
    open_ = head == sizes
    waiting = np.flatnonzero(head > 0)
    while len(waiting):
        ready = waiting[~open_[waiting - 1]]
        before = state[ready - 1]
        end, more, _ = machine.read(before, codes, starts[ready], head[ready], (state,))
        count[ready] += more
        state[ready] = np.where(open_[ready], end, state[ready])
        waiting = waiting[open_[waiting - 1]]
        open_[ready] = False
    sums = np.cumsum(count)
    before = np.r_[0, sums][first]
    return [sums[f : f + n] - b for f, n, b in zip(first.tolist(), chunks.tolist(), before.tolist())]


def count_tokens(
    docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", limit: int = 4096, chunk: int = CHUNK
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, ``n_bytes``, ``n_tokens``, ``over_limit``, ``chunk_tokens``.

    ``n_bytes`` counts UTF-8 bytes, ``n_tokens`` the tokens that the model's own library gives for the whole text without
    begin and end, and ``chunk_tokens`` those of its prefixes of ``chunk``, 2 ``chunk``, ... characters (the one put before
    every text counts too), so that a text can be cut near a wanted length.  ``over_limit`` tells more than ``limit``
    tokens.  Null and empty texts have none; ties and repeated rows do not matter to a count by row, an empty table gives
    an empty result, and only ``keep`` is taken of the other columns.  Texts of any length are read once, with memory for
    their chunk maps and the bounded machine of the worker.  A narrow job: no shuffle.  The model is read on the
    driver and travels with the query.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, prefix = model.value.machine(), model.value.prefix
        for batch in batches:
            texts, counts = batch.column(n).to_pylist(), []
            while len(counts) < len(texts):
                end, size = len(counts), 0
                while end < len(texts) and size < SIDE_BY_SIDE:
                    size, end = size + len(texts[end] or ""), end + 1
                counts += count_texts(machine, texts[len(counts) : end], prefix, chunk)
            totals = [int(c[-1]) for c in counts]
            columns = [
                *[batch.column(i) for i in range(n)],
                batch.column(n + 1),
                pa.array(totals, pa.int64()),
                pa.array([t > limit for t in totals], pa.bool_()),
                pa.array(counts, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_bytes", "n_tokens", "over_limit", "chunk_tokens"])

    text = F.col(text_col).cast("string")
    read = docs.select(*keep, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes" if text_col != "n_bytes" else "_n_bytes"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return read.mapInArrow(run, f"{kept}, n_bytes long, n_tokens long, over_limit boolean, chunk_tokens array<long>")
