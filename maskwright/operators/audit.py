"""The audit log: hashes and counts only, never text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.hashing import audit_id, prompt_hash
from maskwright.functions.text import utf16_length
from maskwright.operators.review import distinct_types

DAY_MS = 86_400_000


def audit_entries(sanitized: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """One log entry per scanned text.  ``elapsed_ms`` stays null: there is no clock per row."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    scanned = sanitized.where(F.col("scanned"))
    return scanned.select(
        audit_id(F.col("ts"), key).alias("id"),
        F.col("ts"),
        prompt_hash(F.col(text_col)).alias("prompt_hash"),
        utf16_length(F.col(text_col)).alias("prompt_length"),
        distinct_types(F.col("detections")).alias("pii_types"),
        F.col("pii_count"),
        F.lit(None).cast("long").alias("elapsed_ms"),
        F.when(F.coalesce("domain", F.lit("")) == "", "unknown").otherwise(F.col("domain")).alias("domain"),
        F.to_date("ts").alias("day"),
    )


def audit_json(audit: DataFrame) -> DataFrame:
    """The log as one JSON object per entry, with the exported field names and epoch milliseconds."""
    entry = F.struct(
        F.col("id"),
        F.unix_millis("ts").alias("timestamp"),
        F.col("prompt_hash").alias("promptHash"),
        F.col("prompt_length").alias("promptLength"),
        F.col("pii_types").alias("piiTypes"),
        F.col("pii_count").alias("piiCount"),
        F.col("elapsed_ms").alias("elapsedMs"),
        F.col("domain"),
    )
    return audit.select("id", F.to_json(entry, {"ignoreNullFields": "false"}).alias("json"))


def recent(audit: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest entries first; with a limit Spark keeps only that many per task."""
    ordered = audit.orderBy(F.col("ts").desc(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def retained(audit: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Entries young enough to keep.  The condition on ``day`` prunes partitions."""
    cutoff = F.timestamp_millis(F.lit(now_ms - days * DAY_MS))
    return audit.where((F.col("day") >= F.to_date(cutoff)) & (F.col("ts") >= cutoff))


def session_stats(sanitized: DataFrame) -> DataFrame:
    """Prompts scanned and personal data caught; rows that were not scanned do not count."""
    scanned = sanitized.where(F.col("scanned"))
    return scanned.agg(
        F.count("*").alias("prompts_processed"), F.coalesce(F.sum("pii_count"), F.lit(0)).alias("pii_caught")
    )


def audit_report(audit: DataFrame) -> DataFrame:
    """Entries per domain, type and day, with totals over every combination of domain and type."""
    # An outer explode, so that the optimizer puts no copy of the scan into a filter in front of it.
    typed = audit.select("day", "domain", F.explode_outer("pii_types").alias("type")).where(F.col("type").isNotNull())
    return typed.cube("domain", "type", "day").agg(F.count("*").alias("entries"))


def detector_quality(labelled: DataFrame, predicted: Column, expected: Column, types: Sequence[str]) -> DataFrame:
    """Precision, recall and false-positive rate per type.

    ``predicted`` and ``expected`` are arrays of types.  Each text contributes
    one row per type and is aggregated before anything is shuffled.
    """
    flags = labelled.select(
        F.explode(F.array(*[F.lit(t) for t in types])).alias("type"),
        predicted.alias("predicted"),
        expected.alias("expected"),
    ).select(
        "type",
        F.array_contains("predicted", F.col("type")).alias("p"),
        F.array_contains("expected", F.col("type")).alias("e"),
    )

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return flags.groupBy("type").agg(
        count(F.col("p") & F.col("e")).alias("true_positives"),
        count(F.col("p") & ~F.col("e")).alias("false_positives"),
        count(~F.col("p") & F.col("e")).alias("false_negatives"),
        count(~F.col("p") & ~F.col("e")).alias("true_negatives"),
        (count(F.col("p") & F.col("e")) / F.nullif(count(F.col("p")), F.lit(0))).alias("precision"),
        (count(F.col("p") & F.col("e")) / F.nullif(count(F.col("e")), F.lit(0))).alias("recall"),
        (count(F.col("p") & ~F.col("e")) / F.nullif(count(~F.col("e")), F.lit(0))).alias("false_positive_rate"),
    )
