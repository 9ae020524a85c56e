"""Language of documents: the family first, then the language within it.

A family is chosen by one linear support vector machine against the rest for
each family; within it, one machine for each pair of languages votes.  Features
are the byte trigrams of the lower-cased text, hashed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 4096
#: Labelled documents of each language that are learned from: those with the least hash of their id.
PER_LANGUAGE = 400
#: Texts of other families that a family's machine learns from, dealt evenly to their languages (four of each at least).
OTHERS = 2000
#: Rows of languages and of sampled ids (some 20 bytes each) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of which a machine holds doubles at a time.
BLOCK = 64
UNKNOWN = "und"
#: Probability of its family from which a document is kept: the machine of one family at least takes it rather for its own.
MIN_SCORE = 0.5

# Families of languages by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur mr ne pa gu",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# Every byte that is no letter becomes a blank; bytes of other scripts stay.
_LETTERS = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.int64)


def features(text: str | None) -> np.ndarray | None:
    """Hashed trigram frequencies (roots, of length 1); None for a text without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(FEATURES)
    for start in range(0, len(data) - 2, 1 << 20):
        b = _LETTERS[data[start : start + (1 << 20) + 2]]
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        code = code[(b[:-2] != 32) | (b[1:-1] != 32)]
        counts += np.bincount((code * 2654435761 >> 12) % FEATURES, minlength=FEATURES)
    roots = np.sqrt(counts)
    return (roots / max(np.linalg.norm(roots), 1e-12)).astype(np.float32)


def linear_svm(x: np.ndarray | Sequence[np.ndarray], y: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights (the last is the offset) of a squared-hinge linear machine for y in {-1, 1}, and the slope that turns
    its margins into probabilities.  Both classes weigh the same.  Accelerated gradient steps from zero.

    ``x`` may be several matrices, one below the other.  They are read block by block, so that beside them no more than
    ``BLOCK`` rows of doubles are held.
    """
    parts = [x] if isinstance(x, np.ndarray) else list(x)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    step = 1 / (4 * np.sqrt(penalty) + 4)
    room = np.ones((BLOCK, parts[0].shape[1] + 1))

    def blocks() -> Iterator[tuple[slice, np.ndarray]]:
        at = 0
        for part in parts:
            for start in range(0, len(part), BLOCK):
                n = min(BLOCK, len(part) - start)
                room[:n, :-1] = part[start : start + n]
                yield slice(at, at + n), room[:n]
                at += n

    w = ahead = np.zeros(room.shape[1])
    for k in range(rounds):
        pull = np.zeros(len(w))
        for rows, block in blocks():
            pull += (np.maximum(0, 1 - y[rows] * (block @ ahead)) * y[rows] * share[rows]) @ block
        new = ahead - step * (penalty * ahead - 2 * pull)
        w, ahead = new, new + k / (k + 3) * (new - w)
    margins = y * np.concatenate([np.zeros(0), *[block @ w for _, block in blocks()]])
    slopes = np.array([1, 2, 3, 4, 6, 8, 12, 16])
    losses = [(share * np.log1p(np.exp(np.clip(-s * margins, -50, 50)))).sum() for s in slopes]
    return w, float(slopes[int(np.argmin(losses))])


@dataclass(frozen=True)
class LanguageModel:
    families: tuple[tuple[str, ...], ...]  # the languages of each family
    family_rows: np.ndarray  # weights, a row for each family
    family_slopes: np.ndarray
    pairs: tuple[tuple[int, int, int], ...]  # family, first and second language in it
    pair_rows: np.ndarray
    pair_slopes: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages and scores: the family's own probability times the language's share of its pairs; and the
        former."""
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margins = (x @ self.family_rows.T) * self.family_slopes
        own = 1 / (1 + np.exp(-np.clip(margins, -50, 50)))
        family = own.argmax(axis=1)
        sure_of = own[np.arange(len(x)), family]
        score = sure_of.copy()
        wins = [np.zeros((len(x), len(f))) for f in self.families]
        sure = [np.zeros((len(x), len(f))) for f in self.families]
        for (f, a, b), row, slope in zip(self.pairs, self.pair_rows, self.pair_slopes):
            p = 1 / (1 + np.exp(-np.clip(slope * (x @ row), -50, 50)))
            wins[f][:, a] += p >= 0.5
            wins[f][:, b] += p < 0.5
            sure[f][:, a] += p
            sure[f][:, b] += 1 - p
        names = []
        for i, f in enumerate(family):
            n = len(self.families[f])
            best = max(range(n), key=lambda k: (wins[f][i, k], sure[f][i, k])) if n > 1 else 0
            names.append(self.families[f][best])
            if n > 1:
                score[i] *= sure[f][i, best] / (n - 1)
        return names, score, sure_of


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"other {lang}")


def fit_family(x: np.ndarray, langs: Sequence[str], others: np.ndarray) -> list[tuple[str | None, str | None, np.ndarray, float]]:
    """The machines of a family: against others (without languages), and for each pair of its languages."""
    langs = np.array(langs)
    names = sorted(set(langs))
    made = [(None, None, *linear_svm([x, others], np.r_[np.ones(len(x)), -np.ones(len(others))]))]
    for a, b in combinations(names, 2):
        rows = (langs == a) | (langs == b)
        made.append((a, b, *linear_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))))
    return made


def assembled(languages: dict[str, list[str]], machines: Sequence[tuple]) -> LanguageModel:
    """A model from ``(family, a, b, weights, slope)`` of all machines."""
    names = sorted(languages)
    tops = {m[0]: m[3:] for m in machines if m[1] is None}
    lows = sorted((m for m in machines if m[1] is not None), key=lambda m: m[:3])
    families = tuple(tuple(sorted(languages[f])) for f in names)
    pairs = tuple((names.index(f), families[names.index(f)].index(a), families[names.index(f)].index(b)) for f, a, b, *_ in lows)

    def rows(fits: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array([f[0] for f in fits], np.float32).reshape(-1, FEATURES + 1), np.array([f[1] for f in fits])

    return LanguageModel(families, *rows([tops[f] for f in names]), pairs, *rows([m[3:] for m in lows]))


def learnable(id_col: str = "doc_id") -> Column:
    """Documents that may be learned from; the rest is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def train(
    docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    others: int = OTHERS,
) -> LanguageModel | None:
    """Learn from up to ``per_language`` labelled texts (of rows that share an id, one) of every language.

    Rows without id, language or letter and held-out rows are not learned from.  A share of each language, by a hash of
    the id, is ranked: twice what is wanted on average of its different ids, so that a language of any size gives a few rows.
    The machines of a family are fitted in one task, from the sample of its languages and up to ``others`` texts of other
    families; only the weights come to the driver.  None if there is nothing to learn from.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        learnable(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    )
    counts = staged(usable.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("count")), "languages")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = staged(
        usable.select("id", "lang").join(counts, "lang").where(draw * F.col("count") < 2 * per_language)
        .select("id", "lang").distinct().withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_language), "chosen",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column(2).to_pylist()]
            packed = pa.array([None if f is None else f.tobytes() for f in made], pa.binary())
            families = pa.array([family_of(v) for v in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), families, batch.column(3), packed], ["id", "lang", "family", "rank", "x"])

    id_type = usable.schema["id"].dataType.simpleString()
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    sample = staged(
        usable.join(few, ["id", "lang"]).select("id", "lang", "text", "rank")
        .mapInArrow(run, f"id {id_type}, lang string, family string, rank int, x binary").where("x is not null")
        .groupBy("id", "lang", "family", "rank").agg(F.min("x").alias("x")), "sample",
    )
    languages: dict[str, list[str]] = {}
    for r in sample.select("lang", "family").distinct().collect():
        languages.setdefault(r["family"], []).append(r["lang"])
    if not languages:
        return None
    # What other families look like: a bounded sample that every task gets.
    each = max(others // sum(map(len, languages.values())), 4)
    rest = sorted(sample.where(F.col("rank") <= each).select("family", "lang", "id", "x").collect())
    shared = docs.sparkSession.sparkContext.broadcast(
        ([r["family"] for r in rest], np.array([np.frombuffer(r["x"], np.float32) for r in rest]).reshape(-1, FEATURES))
    )

    def fit(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "id"])
        x = np.array([np.frombuffer(v, np.float32) for v in rows["x"]]).reshape(-1, FEATURES)
        families, vectors = shared.value
        machines = fit_family(x, rows["lang"].tolist(), vectors[np.array([f != key[0] for f in families], bool)])
        return pd.DataFrame([(key[0], a, b, w.tobytes(), s) for a, b, w, s in machines], columns=["family", "a", "b", "w", "slope"])

    fitted = sample.groupBy("family").applyInPandas(fit, "family string, a string, b string, w binary, slope double").collect()
    return assembled(languages, [(r["family"], r["a"], r["b"], np.frombuffer(r["w"], np.float64), r["slope"]) for r in fitted])


def predicted(model: LanguageModel | None, text: Column) -> Column:
    """``struct<lang, score, family_score>`` of a text column; ``und`` with score 0 for null, for texts without a letter, and
    without a model."""

    @F.pandas_udf("lang string, score double, family_score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores = np.array([UNKNOWN] * len(texts), dtype=object), np.zeros((2, len(texts)))
        for start in range(0, len(texts), 128):
            made = [features(t) for t in texts.iloc[start : start + 128]]
            at = [start + i for i, f in enumerate(made) if f is not None]
            if at and model is not None:
                langs[at], scores[0, at], scores[1, at] = model.predict(np.array([f for f in made if f is not None]))
        return pd.DataFrame({"lang": langs, "score": scores[0], "family_score": scores[1]})

    return run(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    Only the text decides a prediction, so ties and repeated rows are told alike; a text of any length is counted in pieces
    of a megabyte.  A row without id is neither held out nor learned from.
    """
    model = train(docs, per_language, id_col, text_col, lang_col)
    said = docs.select(
        F.col(id_col), F.coalesce(~learnable(id_col), F.lit(False)).alias("held_out"), predicted(model, F.col(text_col)).alias("p")
    )
    return said.select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is told: those that the machine of some family takes for its own with a
    probability of at least ``min_score``, however many families there are.  The others, and texts without a letter, go.  All
    columns stay as they are."""
    model = train(docs, PER_LANGUAGE, id_col, text_col, lang_col)
    name = "_said"
    while name in docs.columns:
        name += "_"
    said = docs.withColumn(name, predicted(model, F.col(text_col)))
    return said.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.family_score") >= min_score)).drop(name)
