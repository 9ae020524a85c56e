"""Byte-level BPE by sentencepiece, from a plain list of ranks.

The ranks become a sentencepiece model that is written field by field: every
byte is mapped to one character, a piece's score is its negative rank and the
normaliser changes nothing, so the best merge is that of the lowest rank.  Texts
are split by the tokenizer's pattern, each match is encoded by itself, and ids
are decoded by mapping the characters of their pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
import sys
from collections.abc import Iterator, Mapping

import pyarrow as pa
import regex
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Different matches whose ids a task remembers.
REMEMBERED = 200_000

_CHARACTERS = {b: 0x100 + b for b in range(256)}  # bytes as characters that no normaliser treats specially


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def as_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_CHARACTERS)


def sentencepiece_model(ranks: Mapping[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; they have to be 0, 1, 2, ..."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")

    def number(n: int) -> bytes:
        low = n & 0x7F
        return bytes([low]) if n == low else bytes([low | 0x80]) + number(n >> 7)

    def field(key: int, value: int | float | bytes) -> bytes:
        if isinstance(value, float):
            return number(key << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return number(key << 3) + number(value)
        return number(key << 3 | 2) + number(len(value)) + value

    # Field numbers and types of sentencepiece's model format.
    piece, trainer, normaliser, normal, unknown, bpe, absent = 1, 2, 3, 1, 2, 2, (1 << 64) - 1
    parts = [
        field(piece, field(1, as_characters(t).encode()) + field(2, float(-i)) + field(3, normal)) for i, t in enumerate(tokens)
    ]
    parts.append(field(piece, field(1, b"<unk>") + field(2, 0.0) + field(3, unknown)))
    ids = field(40, len(tokens)) + field(41, absent) + field(42, absent) + field(43, absent)  # unk, bos, eos, pad
    parts.append(field(trainer, field(3, bpe) + ids))
    parts.append(field(normaliser, field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)))
    return b"".join(parts)


class Tokenizer:
    """Encodes texts to ids as packed little-endian unsigned 32-bit numbers, and ids to bytes."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        known = range(self.pieces.get_piece_size() - 1)
        self.bytes_of = [bytes(ord(c) - 0x100 for c in self.pieces.id_to_piece(i)) for i in known]
        self.ids_of: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        matches = self.split(text or "")
        ids_of = self.ids_of
        new = list({m for m in matches if m not in ids_of})
        if new:
            if len(ids_of) + len(new) > REMEMBERED:
                ids_of.clear()
                new = list(set(matches))
            found = self.pieces.encode([as_characters(m.encode("utf-8", "surrogatepass")) for m in new], num_threads=1)
            ids_of.update((m, struct.pack(f"<{len(ids)}I", *ids)) for m, ids in zip(new, found))
        return b"".join([ids_of[m] for m in matches])

    def decode(self, ids: bytes) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in memoryview(ids).cast("I")])


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, ``n_tokens``, ``ids``, ``decoded``.

    ``ids`` holds the token ids of the whole text as little-endian unsigned 32-bit numbers, ``decoded`` the bytes that
    these ids stand for.  Null and empty texts have no tokens.  Special tokens are ordinary text.  The file of ranks is
    read on the driver and travels with the query.  A narrow job: no shuffle, and memory for a batch of texts and
    ``REMEMBERED`` different matches in each task.
    """
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer(model.value, pattern)
        for batch in batches:
            ids = [coder.encode(t.as_py()) for t in batch.column(n)]
            columns = [
                *[batch.column(i) for i in range(n)],
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array([coder.decode(i) for i in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids", "decoded"])

    read = docs.select(*keep, F.col(text_col).cast("string"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return read.mapInArrow(run, f"{kept}, n_tokens long, ids binary, decoded binary")
