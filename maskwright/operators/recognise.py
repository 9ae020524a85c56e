"""Any recogniser as a part of a job: its spans are checked against the text before they count."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.operators.entities import LABELS

#: What a recogniser gives for a text: label, start, end (in code points, end excluded), text of the span, confidence.
Span = tuple[str, int, int, str, float]
Tagger = Callable[[Sequence[str]], Sequence[Sequence[Span]]]


def recognise(
    df: DataFrame, load: Callable[[], Tagger], text_col: str = "text", out: str = "recognised", rejected: str = "rejected", batch: int = 64
) -> DataFrame:
    """Add ``out``, the detections of a recogniser, and ``rejected``, the number of its spans that were not taken.

    ``load`` is called once in every task and returns the recogniser, which gets lists of up to ``batch`` texts and gives
    one list of spans for each.  A span is taken if it lies inside its text, has the words it says, a label of
    ``entities.LABELS`` (or a type they stand for) and a confidence from 0 to 1.  Equal spans count once; hits come by start.  Null texts are not shown
    to the recogniser and have no hits.  A recogniser that does not give one list for each text stops the job.  Give
    ``out`` to ``sanitize`` as ``entities_col`` to merge the hits with those of the rules.
    """
    types = {**LABELS, **{t: t for t in LABELS.values()}}

    def checked(text: str, spans: Sequence[Span]) -> tuple[list[dict], int]:
        kept, bad = {}, 0
        for label, start, end, value, confidence in spans:
            inside = isinstance(start, int) and isinstance(end, int) and 0 <= start < end <= len(text)
            if inside and text[start:end] == value and label in types and 0 <= confidence <= 1:
                kept.setdefault((start, end, types[label]), float(confidence))
            else:
                bad += 1
        hits = [
            {"type": t, "value": text[s:e], "start": s, "end": e, "confidence": c, "source": "ner"} for (s, e, t), c in sorted(kept.items())
        ]
        return hits, bad

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for texts in batches:
            hits: list[list[dict]] = [[] for _ in texts]
            bad = [0] * len(texts)
            given = [i for i, t in enumerate(texts) if t is not None]
            for begin in range(0, len(given), batch):
                part = given[begin : begin + batch]
                found = tagger([texts.iloc[i] for i in part])
                if len(found) != len(part):
                    raise ValueError(f"the recogniser gave {len(found)} lists for {len(part)} texts")
                for i, spans in zip(part, found):
                    hits[i], bad[i] = checked(texts.iloc[i], spans)
            yield pd.DataFrame({"hits": pd.Series(hits, dtype=object), "bad": bad})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    tagged = F.pandas_udf(run, f"hits {schemas.DETECTIONS}, bad int")
    return df.withColumn("_tagged", tagged(F.col(text_col))).withColumns({out: F.col("_tagged.hits"), rejected: F.col("_tagged.bad")}).drop("_tagged")
