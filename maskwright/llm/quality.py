"""Quality of documents by weak supervision.

Rules look at a document and vote for good or bad, or abstain.  Expectation
maximisation finds, from the votes alone, how likely each vote of each rule is
for good and for bad documents; a document's posterior probability of being
good then decides, instead of every rule having to pass.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Bytes of text of which word windows are compared at a time (a longer text is a piece of its own).
PIECE = 4 << 20
#: Rounds of expectation maximisation, and the added votes that keep every probability above 0.
ROUNDS, SMOOTHING = 200, 1.0

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper", "n_letters", "n_stops", "n_plain")


def _repeated_words(words: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """For texts of ``sizes`` words each: words inside a three-word window that the text has twice or more."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if len(words) < 3:
        return np.zeros(len(sizes), np.int64)
    ids = pa.array(words, pa.large_binary()).dictionary_encode()
    n, ids = len(ids.dictionary), ids.indices.to_numpy().astype(np.int64)
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1].astype(np.int64)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    window = (pairs[:-1] * n + ids[2:])[at]
    order = np.argsort(window, kind="stable")  # texts stay in order within equal windows
    w, d = window[order], doc[at[order]]
    same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[at[twice] + k] = True
    return np.bincount(doc[inside], minlength=len(sizes))


def text_stats(texts: Sequence[str | None]) -> dict[str, np.ndarray]:
    """The columns ``STATS`` of some texts."""
    rows, repeated, words, sizes, held = [], [np.zeros(0, np.int64)], [], [], 0
    for text in texts:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        own = data.split()  # at ASCII white space
        lines = text.split("\n")
        seen = Counter(line for line in lines if line.strip(WHITE))
        rows.append((
            len(own),
            len(text) - sum(map(text.count, WHITE)),
            sum(map(text.count, SYMBOLS)),
            seen.total() - len(seen),
            seen.total(),
            text.count("!"),
            len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
            len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")),
            sum(map(text.count, ".!?")),
            len(b"".join([w[-1:] for w in own]).translate(None, b"!" + SYMBOLS.encode())),
        ))
        words += own
        sizes.append(len(own))
        held += len(data)
        if held > PIECE:
            repeated.append(_repeated_words(words, np.array(sizes)))
            words, sizes, held = [], [], 0
    if sizes:
        repeated.append(_repeated_words(words, np.array(sizes)))
    table = np.array(rows, np.int64).reshape(-1, 10)
    names = [s for s in STATS if s != "n_repeat_words"]
    return {**dict(zip(names, table.T)), "n_repeat_words": np.concatenate(repeated)}


def with_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and the columns ``STATS``, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = text_stats(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(stats[s], pa.int64()) for s in STATS]], ["id", *STATS])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, " + ", ".join(f"{s} long" for s in STATS)).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class VoteRule:
    """``bad`` and ``good`` are SQL conditions over ``STATS``; neither, or an unknown one, abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        """0 bad, 1 abstains, 2 good."""
        return F.when(F.expr(self.bad), 0).when(F.expr(self.good), 2).otherwise(1)


# What is usual in prose says little by itself: most rules only vote when they see something wrong.
RULES = (
    VoteRule("symbols", "10 * n_symbols > n_words", "100 * n_symbols < n_words"),
    VoteRule("plain_words", "10 * n_plain < 7 * n_words", "100 * n_plain > 95 * n_words"),
    VoteRule("sentences", "100 * n_stops < n_words or 2 * n_stops > n_words", "50 * n_stops > n_words and 4 * n_stops < n_words"),
    VoteRule("shouting", "5 * n_shouts > n_words", "false"),
    VoteRule("upper_case", "10 * n_upper > 4 * n_letters", "false"),
    VoteRule("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    VoteRule("repeated_words", "10 * n_repeat_words > 4 * n_words", "false"),
    VoteRule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "false"),
)


@dataclass(frozen=True)
class VoteModel:
    """``prior``: share of good documents; ``table[rule][vote][class]``: probability of a vote (class 0 bad, 1 good)."""

    prior: float
    table: tuple[tuple[tuple[float, float], ...], ...]

    def accuracies(self) -> list[float]:
        """Of each rule's votes that do not abstain, the expected share of right ones."""
        p, out = self.prior, []
        for bad, _, good in self.table:
            right, cast = p * good[1] + (1 - p) * bad[0], p * (good[1] + bad[1]) + (1 - p) * (good[0] + bad[0])
            out.append(right / cast)
        return out


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> VoteModel:
    """Expectation maximisation over the distinct patterns of votes and how many documents have each.

    Starts from the majority of votes, which decides which class is the good one.
    """
    n_rules = patterns.shape[1]
    votes = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    lead = (patterns - 1).sum(axis=1)
    good = np.where(lead > 0, 0.9, np.where(lead < 0, 0.1, 0.5))
    prior, table = 0.5, np.full((n_rules, 3, 2), 1 / 3)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good], axis=1)
        prior = (mass[:, 1].sum() + SMOOTHING) / (mass.sum() + 2 * SMOOTHING)
        table = np.einsum("prv,pc->rvc", votes, mass) + SMOOTHING
        table /= table.sum(axis=1, keepdims=True)
        logs = np.einsum("prv,rvc->pc", votes, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        moved, good = np.abs(new - good).max(initial=0.0), new
        if moved < 1e-9:
            break
    return VoteModel(float(prior), tuple(tuple((float(v[0]), float(v[1])) for v in rule) for rule in table))


def posterior(model: VoteModel, votes: Sequence[Column]) -> Column:
    """Probability that a document with these votes is good."""
    def ratio(rule: tuple, vote: Column) -> Column:
        logs = [float(np.log(v[1] / v[0])) for v in rule]
        return F.when(vote == 0, logs[0]).when(vote == 2, logs[2]).otherwise(logs[1])

    logit = reduce(lambda a, b: a + b, map(ratio, model.table, votes), F.lit(float(np.log(model.prior / (1 - model.prior)))))
    return 1 / (1 + F.exp(-logit))


def judge(
    docs: DataFrame, rules: Sequence[VoteRule] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, VoteModel]:
    """One row per row of ``docs`` with the id, ``STATS``, ``base_failed``, ``posterior`` and ``kept``; and the model.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows.  ``kept``: the base holds and the
    posterior reaches ``threshold``.  All documents count for the model; what comes to the driver is one number for
    each pattern of votes, of which there are 3 to the number of rules at most.  A null text is empty.  Repeated rows
    count as often as they are there; an empty table gives an empty result and an even model.
    """
    stats = staged(with_stats(docs, id_col, text_col), "stats")
    votes = [r.vote().alias(f"v{i}") for i, r in enumerate(rules)]
    found = stats.groupBy(*votes).agg(F.count("*").alias("n")).collect()
    table = np.array([list(r) for r in found], np.int64).reshape(-1, len(rules) + 1)
    table = table[np.lexsort(table.T)]  # the same sums in whatever order the rows come
    model = fit_votes(table[:, :-1], table[:, -1])
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    judged = stats.withColumns({"base_failed": failed, "posterior": posterior(model, [r.vote() for r in rules])})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)), model
