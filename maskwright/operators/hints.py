"""Indirect identifiers: phrases that hint at who the writer is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions.arrays import let
from maskwright.functions.reuse import built_once
from maskwright.operators.detect import rule_hits, spans_of
from maskwright.policy import Policy
from maskwright.rules import HINT_OPENING, HINTS, Rule


def hints(text: Column, rules: Sequence[Rule] = HINTS) -> Column:
    """All hits, not deduplicated, ordered by rule and then by position."""
    none = F.array().cast(schemas.HINTS)

    def collect(may_hint: Column) -> Column:
        found = F.transform(
            spans_of(rule_hits(text, rules, may_hint)),
            lambda s: F.struct(
                s["type"].alias("type"),
                s["value"].alias("match"),
                s["reason"].alias("reason"),
                s["start"].alias("index"),
            ),
        ).cast(schemas.HINTS)
        return F.when(may_hint, found).otherwise(none)

    return F.when(text.isNotNull(), let(F.rlike(text, F.lit(HINT_OPENING)), collect))


def column_hints(df: DataFrame, text_col: str, rules: tuple[Rule, ...] = HINTS) -> Column:
    """The indirect identifiers of a column of ``df``."""
    return built_once(df, _of_column, text_col, rules)


def _of_column(text_col: str, rules: tuple[Rule, ...]) -> Column:
    return hints(F.col(text_col), rules)


def semantic_hits(
    df: DataFrame, text_col: str = "text", policy: Policy = Policy(), out: str = "semantic_hits"
) -> DataFrame:
    """Add the indirect identifiers; they are advisory and never redacted."""
    found = column_hints(df, text_col) if policy.semantic_scrubbing else F.array().cast(schemas.HINTS)
    return df.withColumn(out, found)


def hint_type(df: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """Add the hits of one kind of indirect identifier."""
    rules = tuple(r for r in HINTS if r.type == kind)
    return df.withColumn("semantic_hits", column_hints(df, text_col, rules))
