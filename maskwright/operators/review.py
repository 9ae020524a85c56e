"""What a reviewer sees of a scan: risk, severity, previews, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.dialect import to_jvm
from maskwright.functions.arrays import let
from maskwright.functions.text import cutter, preview
from maskwright.rules import HIGH_RISK_TYPES

# Shape of a token in a redacted text, and the severity steps.
TOKEN_SHAPE = r"\[[A-Z_]+_\d+\]"
RED_FROM = 4
DETECTION_PREVIEW = 40
TOKEN_PREVIEW = 32

DECISIONS = ("redact", "original", "quarantine")


def distinct_types(detections: Column) -> Column:
    """Types of a text in order of appearance."""
    return F.array_distinct(F.transform(detections, lambda d: d["type"]))


def high_risk_flag(detections: Column) -> Column:
    return F.exists(detections, lambda d: d["type"].isin(*HIGH_RISK_TYPES))


def high_risk_types(detections: Column) -> Column:
    """Distinct high-risk types in order of appearance."""
    return F.filter(distinct_types(detections), lambda t: t.isin(*HIGH_RISK_TYPES))


def action_of(detections: Column, on_high_risk: str) -> Column:
    """``clean``, ``redacted``, ``original`` or ``quarantined``."""
    if on_high_risk not in DECISIONS:
        raise ValueError(f"on_high_risk must be one of {DECISIONS}, not {on_high_risk!r}")
    taken = {"redact": "redacted", "original": "original", "quarantine": "quarantined"}[on_high_risk]
    return (
        F.when(high_risk_flag(detections), F.lit(taken)).when(F.size(detections) > 0, F.lit("redacted")).otherwise(F.lit("clean"))
    )


def outgoing(action: Column, text: Column) -> Column:
    return F.when(action == "original", text).when(action != "quarantined", F.col("sanitized"))


def route(df: DataFrame, on_high_risk: str = "redact", text_col: str = "text") -> DataFrame:
    """Decide per row what is sent on, and record it.

    Adds ``action`` and ``outgoing`` (null while quarantined).
    """
    action = action_of(F.col("detections"), on_high_risk)
    return df.withColumn("action", action).withColumn("outgoing", outgoing(F.col("action"), F.col(text_col)))


def split_quarantine(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to send and the rows held back."""
    held = F.col("action") == "quarantined"
    return routed.where(~held), routed.where(held)


def severity(pii_count: Column) -> Column:
    return F.when(pii_count == 0, "clean").when(pii_count >= RED_FROM, "red").otherwise("amber")


def severity_label(pii_count: Column) -> Column:
    return (
        F.when(pii_count == 0, F.lit("✓ Clean"))
        .when(pii_count == 1, F.lit("🔒 1 item redacted"))
        .otherwise(F.format_string("🔒 %d items redacted", pii_count))
    )


def findings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections, then indirect identifiers, of every text as one report."""
    rows = F.concat(
        F.transform(
            "detections",
            lambda d, i: F.struct(
                F.lit("detection").alias("kind"),
                i.alias("seq"),
                d["type"].alias("type"),
                preview(d["value"], DETECTION_PREVIEW).alias("value"),
                F.lit(None).cast("string").alias("reason"),
            ),
        ),
        F.transform(
            "semantic_hits",
            lambda h, i: F.struct(
                F.lit("hint").alias("kind"),
                i.alias("seq"),
                h["type"].alias("type"),
                h["match"].alias("value"),
                h["reason"].alias("reason"),
            ),
        ),
    )
    exploded = df.select(*keys, F.explode_outer(rows).alias("f"))
    return exploded.where(F.col("f").isNotNull()).select(*keys, "f.*")


def _segment(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def _original_segments(text: Column, spans: Column) -> Column:
    """Plain text and detected values in turn; empty plain pieces are left out."""

    def pieces(cut) -> Column:
        return F.concat(
            F.flatten(
                F.transform(
                    spans,
                    lambda s, i: let(
                        F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]),
                        lambda cursor: F.array(
                            _segment("plain", cut(cursor, s["start"] - cursor)), _segment("pii", s["value"])
                        ),
                    ),
                )
            ),
            let(
                F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)),
                lambda e: F.array(_segment("plain", cut(e, F.char_length(text) - e))),
            ),
        )

    return cutter(text, pieces)


def _sanitized_segments(text: Column) -> Column:
    regex = to_jvm(TOKEN_SHAPE)

    def with_tokens(tokens: Column) -> Column:
        return let(
            F.split(text, regex, -1),
            lambda gaps: F.flatten(
                F.transform(
                    gaps,
                    lambda g, i: F.filter(
                        F.array(_segment("plain", g), _segment("token", F.get(tokens, i))),
                        lambda s: s["text"].isNotNull(),
                    ),
                )
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), with_tokens)


def diff_segments(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Original and redacted text cut into marked and plain pieces, one row each."""

    def side(name: str, segments: Column) -> Column:
        return F.transform(
            F.filter(segments, lambda s: F.length(s["text"]) > 0),
            lambda s, i: F.struct(
                F.lit(name).alias("side"), i.alias("seq"), s["kind"].alias("kind"), s["text"].alias("text")
            ),
        )

    both = F.concat(
        side("original", _original_segments(F.col(text_col), F.col("detections"))),
        side("sanitized", _sanitized_segments(F.col("sanitized"))),
    )
    rows = df.select(*keys, F.explode_outer(both).alias("s"))
    return rows.where(F.col("s").isNotNull()).select(*keys, "s.*")


