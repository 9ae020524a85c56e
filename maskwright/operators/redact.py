"""Replacing detected spans by tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions.arrays import first_per_key, let, max_before, number_per_type
from maskwright.functions.reuse import built_once
from maskwright.functions.text import cutter

MODES = ("reference", "safe")


def token(kind: Column, number: Column) -> Column:
    """``[TYPE_nn]`` with at least two digits."""
    return F.format_string("[%s_%02d]", kind, number)


def cover(text: Column, spans: Column) -> Column:
    """Merge overlapping spans so that every detected character is covered once.

    Of spans that overlap, the earliest (then longest, then first rule) gives
    type and confidence; it is stretched to the end of the spans it touches,
    so no part of a detected value stays in the text.
    """

    def ordered(xs: Column) -> Column:
        apart = ~F.exists(
            F.sequence(F.lit(0), F.size(xs) - 1),
            lambda i: (i > 0) & (F.get(xs, i)["start"] < F.get(xs, i - 1)["end"]),
        )

        def merged(reach: Column) -> Column:
            starts = F.filter(
                F.sequence(F.lit(0), F.size(xs) - 1),
                lambda i: (i == 0) | (F.get(xs, i)["start"] >= F.get(reach, i)),
            )

            def joined(ss: Column) -> Column:
                return cutter(
                    text,
                    lambda cut: F.transform(
                        F.transform(
                            ss,
                            lambda s, k: F.struct(
                                F.get(xs, s).alias("x"),
                                F.array_max(
                                    F.transform(
                                        F.slice(
                                            xs, s + 1, F.coalesce(F.get(ss, k + 1), F.size(xs)) - s
                                        ),
                                        lambda y: y["end"],
                                    )
                                ).alias("end"),
                            ),
                        ),
                        lambda g: F.struct(
                            g["x"]["type"].alias("type"),
                            cut(g["x"]["start"], g["end"] - g["x"]["start"]).alias("value"),
                            g["x"]["start"].alias("start"),
                            g["end"].alias("end"),
                            g["x"]["confidence"].alias("confidence"),
                            g["x"]["source"].alias("source"),
                        ),
                    ),
                )

            return let(starts, joined)

        return F.when(apart, xs).otherwise(
            let(max_before(F.transform(xs, lambda x: x["end"])), merged).cast(schemas.DETECTIONS)
        )

    by_start = F.transform(
        F.array_sort(
            F.transform(
                spans,
                lambda s, i: F.struct(
                    s["start"].alias("start"), (-s["end"]).alias("back"), i.alias("i"), s.alias("s")
                ),
            )
        ),
        lambda x: x["s"],
    )
    return F.when(F.size(spans) == 0, spans).otherwise(let(by_start, ordered))


def substitute(text: Column, spans: Column, labels: Column) -> Column:
    """Write ``labels`` over ``spans``, which are in text order.

    Where a span starts before the previous one ended, nothing is copied in
    between; the cursor then moves to its end, even backwards.
    """

    def pieces(cut: Callable[[Column, Column], Column]) -> Column:
        body = F.transform(
            spans,
            lambda s, i: let(
                F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]),
                lambda cursor: F.concat(cut(cursor, s["start"] - cursor), F.get(labels, i)),
            ),
        )
        end = F.get(spans, F.size(spans) - 1)["end"]
        return F.concat(F.array_join(body, ""), let(end, lambda e: cut(e, F.char_length(text) - e)))

    return F.when(F.size(spans) == 0, text).otherwise(cutter(text, pieces))


def tokens_of(spans: Column, labels: Column) -> Column:
    """The distinct (token, value) pairs of the spans of a text."""
    pairs = F.transform(
        spans,
        lambda s, i: F.struct(
            F.get(labels, i).alias("token"), s["value"].alias("value"), s["type"].alias("type")
        ),
    )
    return F.transform(
        let(pairs, lambda ps: first_per_key(ps, lambda p: F.struct(p["token"], p["value"]))),
        lambda p, i: F.struct(p["token"], p["value"], p["type"], i.alias("seq")),
    ).cast(schemas.TOKENS)


def rewritten(text_col: str, detections_col: str, mode: str, label: Callable[[Column], Column]) -> Column:
    """The struct ``(sanitized, tokens)``; ``label`` maps the spans to their replacements."""
    text = F.col(text_col)

    def with_spans(spans: Column) -> Column:
        return let(
            label(spans),
            lambda labels: F.struct(
                substitute(text, spans, labels).alias("sanitized"),
                tokens_of(spans, labels).alias("tokens"),
            ),
        )

    found = F.col(detections_col)
    spans = cover(text, found) if mode == "safe" else found
    untouched = F.struct(
        text.alias("sanitized"), F.array().cast(schemas.TOKENS).alias("tokens")
    )
    return F.when(F.size(found) > 0, let(spans, with_spans)).otherwise(untouched)


def rewrite(df: DataFrame, mode: str, build: Callable[..., Column], *args) -> DataFrame:
    """Add ``sanitized`` and ``tokens`` from the struct that ``build(*args)`` yields."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return (
        df.withColumn("_rewritten", built_once(df, build, *args))
        .withColumns({"sanitized": F.col("_rewritten.sanitized"), "tokens": F.col("_rewritten.tokens")})
        .drop("_rewritten")
    )


# A token as it may stand in a text: its type and number.
TOKEN = r"\[([^\[\]]+)_([0-9]{2,9})\]"


def tokens_in(text: Column) -> Column:
    """Tokens a text holds already, as an array of ``struct<type, n>``."""
    return F.transform(
        F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))),
        lambda t: F.struct(F.regexp_extract(t, TOKEN, 1).alias("type"), F.regexp_extract(t, TOKEN, 2).cast("long").alias("n")),
    )


def _redacted(text_col: str, detections_col: str, mode: str) -> Column:
    def label(spans: Column) -> Column:
        def tokens(ns: Column) -> Column:
            return F.transform(spans, lambda s, i: token(s["type"], F.get(ns, i)))

        def behind(ns: Column) -> Column:
            def numbers(held: Column) -> Column:
                last = lambda t: F.array_max(F.transform(F.filter(held, lambda h: h["type"] == t), lambda h: h["n"]))
                return F.when(F.size(held) == 0, tokens(ns)).otherwise(
                    F.transform(spans, lambda s, i: token(s["type"], F.get(ns, i) + F.coalesce(last(s["type"]), F.lit(0))))
                )

            return let(tokens_in(F.col(text_col)), numbers)

        return let(number_per_type(spans), behind if mode == "safe" else tokens)

    return rewritten(text_col, detections_col, mode, label)


def redact(
    df: DataFrame, text_col: str = "text", detections_col: str = "detections", mode: str = "safe"
) -> DataFrame:
    """Replace detections by ``[TYPE_nn]`` tokens, numbered per type within each text.

    ``mode="reference"`` replaces exactly the listed spans in order.
    ``mode="safe"`` expects every occurrence to be listed
    (``detect(..., occurrences="all")``), merges overlaps first and gives equal
    values the same token, so nothing detected stays readable and the text can
    be restored.  Where a text holds tokens already, numbers of their type start
    behind the largest of them.
    """
    return rewrite(df, mode, _redacted, text_col, detections_col, mode)


def token_map(tokens: Column) -> Column:
    """Token -> value as a map; a token listed twice keeps its last value."""
    last = F.reverse(
        let(F.reverse(tokens), lambda ts: first_per_key(ts, lambda t: t["token"]))
    )
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["token"], t["value"])))


def explode_tokens(df: DataFrame, keys: Sequence[str], column: str = "tokens") -> DataFrame:
    """One vault row per token of a text."""
    rows = df.select(*keys, F.explode_outer(column).alias("t"))
    return rows.where(F.col("t").isNotNull()).select(*keys, "t.seq", "t.token", "t.value", "t.type")
