"""Selecting and scanning answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.functions.arrays import let
from maskwright.functions.text import at_least, strip
from maskwright.operators.detect import HAS_DIGIT, rule_hits
from maskwright.operators.gates import MIN_RESPONSE
from maskwright.operators.ordered import RANGE, next_within, previous_value
from maskwright.operators.vault import candidate_rows
from maskwright.rules import BUILT_IN, RESPONSE_TYPES

DEBOUNCE_MS = 1500


def latest_response(turns: DataFrame) -> DataFrame:
    """The last answer of every conversation."""
    return (
        turns.where(F.col("role") == "assistant")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    )


# An hour, where answers are ordered by microseconds instead of turns.
_GATE_RANGE = 3_600_000_000


def response_gate(responses: DataFrame, text_col: str = "text", width: int = RANGE) -> DataFrame:
    """Answers worth scanning: at least 20 characters, and not the text scanned just before."""
    long_enough = responses.withColumn(text_col, strip(F.col(text_col))).where(
        at_least(F.col(text_col), MIN_RESPONSE)
    )
    return (
        previous_value(long_enough, ["conv_id"], "turn", text_col, "_before", width)
        .where(F.col("_before").isNull() | (F.col("_before") != F.col(text_col)))
        .drop("_before")
    )


def debounce_responses(updates: DataFrame, key: str = "conv_id", ts: str = "ts", gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Only changes that stay the last one for ``gap_ms``: the text visible when the timer fires."""
    timed = updates.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return (
        next_within(timed, [key], "_us", gap_ms * 1000, "_followed", width=60_000_000)
        .where(~F.col("_followed"))
        .drop("_followed", "_us")
    )


def pii_warnings(text: Column) -> Column:
    """Every match of the five response rules, in rule order, without deduplication."""
    rules = [r for r in BUILT_IN if r.type in RESPONSE_TYPES]

    def of_rule(hit: Column) -> Column:
        return F.transform(
            hit["values"],
            lambda v: F.struct(
                F.lit("PII_IN_RESPONSE").alias("type"),
                v.alias("value"),
                F.concat(F.lit("AI response contains what looks like a "), hit["type"]).alias("reason"),
            ),
        )

    hits = let(F.rlike(text, F.lit(HAS_DIGIT)), lambda has_digit: rule_hits(text, rules, has_digit))
    return F.when(text.isNotNull(), F.flatten(F.transform(hits, of_rule))).cast(schemas.WARNINGS)


def echo_warning(token: Column) -> Column:
    return F.struct(
        F.lit("TOKEN_ECHO").alias("type"),
        token.alias("value"),
        F.concat(F.lit("AI echoed the redaction token "), token, F.lit(" in its response")).alias("reason"),
    )


def scan_responses(
    responses: DataFrame, vault: DataFrame, text_col: str = "text", any_shape: bool = False
) -> DataFrame:
    """Warnings per answer: tokens of its conversation it repeats, then personal data in it.

    A token counts if it was written in an earlier turn.  The vault is first
    reduced to one row per (conversation, token), so the join cannot multiply
    rows, and only tokens found in an answer are looked up.
    """
    known = (
        vault.groupBy("conv_id", "token")
        .agg(F.min(F.struct("turn", "seq")).alias("first"))
        .select("conv_id", "token", F.col("first.turn").alias("first_turn"), F.col("first.seq").alias("first_seq"))
    )
    asked = candidate_rows(responses, vault if any_shape else None, text_col)
    echoes = (
        asked.join(known, ["conv_id", "token"])
        .where(F.col("first_turn") < F.col("turn"))
        .groupBy("conv_id", "turn")
        .agg(F.sort_array(F.collect_list(F.struct("first_turn", "first_seq", "token"))).alias("_echoes"))
    )
    none = F.array().cast(schemas.WARNINGS)
    echoed = F.coalesce(F.transform("_echoes", lambda e: echo_warning(e["token"])).cast(schemas.WARNINGS), none)
    scanned = responses.select("conv_id", "turn", F.coalesce(pii_warnings(F.col(text_col)), none).alias("_pii"))
    return (
        scanned.join(echoes, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.concat(echoed, "_pii").alias("warnings"), F.col("_echoes").isNotNull().alias("token_echo"))
        .withColumn("echo_detected", F.size("warnings") > 0)
    )


def scan_updates(updates: DataFrame, vault: DataFrame, gap_ms: int = DEBOUNCE_MS, any_shape: bool = False) -> DataFrame:
    """The whole way of an answer: changes of its text, quiet periods, the gate, the scan.

    ``updates`` has ``conv_id, ts, text``, one row per change; ``vault`` has ``conv_id, ts, seq, token`` with the time of
    the prompt.  One row per scanned text, as of its time: ``conv_id, ts, warnings, token_echo, echo_detected``.
    """
    quiet = debounce_responses(updates, gap_ms=gap_ms).withColumn("turn", F.unix_micros(F.col("ts").cast("timestamp")))
    worth = response_gate(quiet, width=_GATE_RANGE)
    written = vault.withColumn("turn", F.unix_micros(F.col("ts").cast("timestamp")))
    scanned = scan_responses(worth, written, any_shape=any_shape)
    return scanned.withColumn("ts", F.timestamp_micros("turn")).drop("turn")


def scan_with_map(text: Column, token_map: Column) -> Column:
    """Warnings for an answer whose token map is held in the same row."""
    echoes = F.transform(
        F.filter(F.map_keys(token_map), lambda t: F.contains(text, t)), echo_warning
    ).cast(schemas.WARNINGS)
    return F.concat(F.coalesce(echoes, F.array().cast(schemas.WARNINGS)), pii_warnings(text))
