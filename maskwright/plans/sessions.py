"""Queries of the vault, restoring and the answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.responses import debounce_responses, latest_response, response_gate, scan_responses, scan_updates
from maskwright.operators.redact import explode_tokens
from maskwright.operators.vault import drop_session_tokens, merge_token_map, restore, vault_rows
from maskwright.plans import oracle
from maskwright.plans.catalog import CATALOG, register
from maskwright.plans.gating import SANITIZED_REF, allowlist, prompts
from maskwright.plans.sanitize import sanitize
from maskwright.plans.seed import seeded_turns
from maskwright.session import work_dir
from maskwright.sources.tables import read_responses, write_vault_table

TURN = list(oracle.TURN_KEYS)


def sanitized(spark: SparkSession, sf: str) -> DataFrame:
    return sanitize(prompts(spark, sf), allowlist=allowlist(spark), mode="reference")


def vault(spark: SparkSession, sf: str) -> DataFrame:
    return vault_rows(sanitized(spark, sf))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return read_responses(seeded_turns(spark, sf))


VAULT = f"{SANITIZED_REF}, vault AS (SELECT conv_id, turn, seq, token, value FROM labelled)"
_ANSWERS = "answers AS (SELECT conv_id, turn, domain, ts, trim(text, chr(32) || chr(9) || chr(10)) AS text FROM seeded WHERE role = 'assistant')"

register(
    "vault",
    lambda spark, sf: merge_token_map(vault(spark, sf)),
    f"WITH {VAULT} SELECT conv_id, token, arg_max(value, turn) AS value FROM vault GROUP BY conv_id, token",
)


def _closed(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that ended with an answer at turn 3 or later."""
    last = seeded_turns(spark, sf).groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max("ts").alias("ts")
    )
    return last.where((F.col("turn") >= 3) & (F.col("role") == "assistant")).select("conv_id", "ts")


register(
    "closed_sessions",
    lambda spark, sf: drop_session_tokens(vault(spark, sf), _closed(spark, sf)),
    f"WITH {VAULT}, closed AS (SELECT conv_id FROM seeded GROUP BY conv_id "
    "HAVING max(turn) >= 3 AND arg_max(role, turn) = 'assistant') "
    "SELECT conv_id, turn, seq, token, value FROM vault WHERE conv_id NOT IN (SELECT conv_id FROM closed)",
)
register(
    "restore",
    lambda spark, sf: restore(responses(spark, sf), vault(spark, sf)).select(*TURN, "restored"),
    f"WITH {VAULT}, {_ANSWERS}, held AS (SELECT a.conv_id, a.turn, v.token, arg_max(v.value, v.turn) AS value "
    "FROM answers a JOIN vault v ON v.conv_id = a.conv_id AND v.turn < a.turn AND contains(a.text, v.token) GROUP BY ALL), "
    "maps AS (SELECT conv_id, turn, list(token ORDER BY token) AS held_tokens, list(value ORDER BY token) AS held_values FROM held GROUP BY ALL) "
    "SELECT a.conv_id, a.turn, CASE WHEN held_tokens IS NULL THEN text ELSE list_reduce(list_prepend(text, range(1, len(held_tokens) + 1)::VARCHAR[]), "
    "lambda acc, i: replace(acc, held_tokens[i::INTEGER], held_values[i::INTEGER])) END AS restored "
    "FROM answers a LEFT JOIN maps m ON a.conv_id = m.conv_id AND a.turn = m.turn",
)


_RESTORED_SQL = CATALOG["restore"].sql


def _restore_from_table(spark: SparkSession, sf: str) -> DataFrame:
    """The vault as a bucketed table."""
    stored = write_vault_table(vault(spark, sf), f"vault_{uuid.uuid4().hex}", work_dir(spark, "vault"))
    return restore(responses(spark, sf), stored).select(*TURN, "restored")


register("restore_from_table", _restore_from_table, _RESTORED_SQL)


def _any_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Beginnings of prompts, of 50 lengths, as tokens; every answer quotes the prompt before it."""
    asked = prompts(spark, sf).select("conv_id", "turn", "text")
    tokens = asked.select("conv_id", "turn", F.lit(0).alias("seq"), F.expr("substr(text, 1, CAST(3 + (conv_id * 7 + turn) % 50 AS INT))").alias("token"))
    quoted = asked.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("quote"))
    answers = responses(spark, sf).join(quoted, TURN, "left").select(*TURN, F.concat_ws(" ", "text", "quote").alias("text"))
    found = scan_responses(answers, tokens, any_shape=True).select(*TURN, F.explode("warnings").alias("w"))
    return found.where(F.col("w.type") == "TOKEN_ECHO").select(*TURN, F.col("w.value").alias("token"))


register(
    "scan_any_shape",
    _any_shape,
    f"WITH {oracle.SEEDED}, {_ANSWERS}, prompts AS (SELECT conv_id, turn, text FROM seeded WHERE role = 'user' AND trim(text) <> ''), "
    "tokens AS (SELECT conv_id, turn, substr(text, 1, CAST(3 + (conv_id * 7 + turn) % 50 AS INTEGER)) AS token FROM prompts), "
    "quoting AS (SELECT a.conv_id, a.turn, concat_ws(' ', a.text, p.text) AS text FROM answers a LEFT JOIN prompts p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1) "
    "SELECT DISTINCT q.conv_id, q.turn, t.token FROM quoting q JOIN tokens t ON t.conv_id = q.conv_id AND t.turn < q.turn AND contains(q.text, t.token)",
)


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scan_responses(responses(spark, sf), vault(spark, sf))
    rows = found.select(*TURN, "echo_detected", "token_echo", F.posexplode_outer("warnings").alias("seq", "w"))
    return rows.select(*TURN, "echo_detected", "token_echo", "seq", "w.type", "w.value", "w.reason")


register(
    "scan_responses",
    _scan,
    f"WITH {VAULT}, {_ANSWERS}, first_write AS (SELECT conv_id, token, min(turn * 1000000 + seq) AS place FROM vault GROUP BY ALL), "
    f"{oracle.response_hits('answers').replace('hits AS', 'found AS', 1)}, "
    "w AS (SELECT a.conv_id, a.turn, 0 AS part, f.place AS a, 0 AS b, 'TOKEN_ECHO' AS type, f.token AS value, "
    "'AI echoed the redaction token ' || f.token || ' in its response' AS reason FROM answers a JOIN first_write f "
    "ON f.conv_id = a.conv_id AND f.place < a.turn * 1000000 AND contains(a.text, f.token) "
    "UNION ALL SELECT conv_id, turn, 1, ord, i, 'PII_IN_RESPONSE', value, 'AI response contains what looks like a ' || type FROM found), "
    "n AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY part, a, b) - 1 AS INTEGER) AS seq, "
    "type, value, reason, part FROM w) "
    "SELECT a.conv_id, a.turn, n.seq IS NOT NULL AS echo_detected, "
    "coalesce(min(n.part) OVER (PARTITION BY a.conv_id, a.turn) = 0, false) AS token_echo, n.seq, n.type, n.value, n.reason "
    "FROM answers a LEFT JOIN n ON n.conv_id = a.conv_id AND n.turn = a.turn",
)
register(
    "latest_response",
    lambda spark, sf: latest_response(seeded_turns(spark, sf)),
    f"WITH {oracle.SEEDED} SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM seeded "
    "WHERE role = 'assistant' GROUP BY conv_id",
)


def repeating(spark: SparkSession, sf: str) -> DataFrame:
    """Whole answers, of which some repeat the one before: turns in pairs get the text of the first of them; a few are
    too short."""
    answers = responses(spark, sf).select(*TURN, "text")
    firsts = answers.select("conv_id", F.col("turn").alias("_turn"), F.col("text").alias("_text"))
    paired = answers.withColumn("_turn", F.col("turn") - F.when(F.col("turn") % 4 == 3, 2).otherwise(0))
    texts = paired.join(firsts, ["conv_id", "_turn"], "left")
    return texts.select(*TURN, F.when(F.col("conv_id") % 7 == 0, F.lit("too short")).otherwise(F.coalesce("_text", "text")).alias("text"))


_REPEATING = (
    f"{oracle.SEEDED}, {_ANSWERS}, repeating AS (SELECT a.conv_id, a.turn, CASE WHEN a.conv_id % 7 = 0 THEN 'too short' "
    "ELSE coalesce(f.text, a.text) END AS text FROM answers a LEFT JOIN answers f ON f.conv_id = a.conv_id "
    "AND f.turn = a.turn - CASE WHEN a.turn % 4 = 3 THEN 2 ELSE 0 END)"
)
CHANGED = (
    f"WITH {_REPEATING}, lagged AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM repeating "
    "WHERE length(text) >= 20) SELECT conv_id, turn, text FROM lagged WHERE before IS NULL OR before <> text"
)
register("response_gate", lambda spark, sf: response_gate(repeating(spark, sf)).select(*TURN, "text"), CHANGED)


def updates(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as they grow on the page: 100 characters more every 700 ms, with a pause after every fourth step."""
    steps = F.sequence(F.lit(0), F.floor(F.length("text") / 100).cast("int"))
    return (
        responses(spark, sf)
        .select("conv_id", "turn", "ts", "text", F.explode(steps).alias("k"))
        .select(
            "conv_id",
            F.timestamp_micros(
                F.unix_micros("ts") + (F.col("k") * 700 + F.floor(F.col("k") / 4) * 1500) * 1000
            ).alias("ts"),
            F.left("text", (F.col("k") + 1) * 100).alias("text"),
        )
    )


DEBOUNCED = (
    f"WITH {oracle.SEEDED}, {_ANSWERS}, steps AS (SELECT *, unnest(range(0, length(text) // 100 + 1)) AS k FROM answers), "
    "changes AS (SELECT conv_id, epoch_us(ts) + (k * 700 + k // 4 * 1500) * 1000 AS us, left(text, CAST((k + 1) * 100 AS INTEGER)) AS text FROM steps), "
    "led AS (SELECT *, lead(us) OVER (PARTITION BY conv_id ORDER BY us) AS next FROM changes) "
    "SELECT conv_id, us, text FROM led WHERE next IS NULL OR next - us >= 1500000"
)
register(
    "debounce",
    lambda spark, sf: debounce_responses(updates(spark, sf)).select("conv_id", F.unix_micros("ts").alias("us"), "text"),
    DEBOUNCED,
)


def prompt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the prompts with the time of their prompt."""
    return explode_tokens(sanitized(spark, sf), ["conv_id", "ts"])


def flow_rows(scanned: DataFrame) -> DataFrame:
    """One row per warning of a scanned answer, or one without."""
    rows = scanned.select("conv_id", F.unix_micros("ts").alias("us"), "token_echo", F.explode_outer("warnings").alias("w"))
    return rows.select("conv_id", "us", "token_echo", "w.type", "w.value", "w.reason")


ANSWER_FLOW = (
    f"WITH {VAULT}, {_ANSWERS}, steps AS (SELECT *, unnest(range(0, length(text) // 100 + 1)) AS k FROM answers), "
    "changes AS (SELECT conv_id, epoch_us(ts) + (k * 700 + k // 4 * 1500) * 1000 AS us, left(text, CAST((k + 1) * 100 AS INTEGER)) AS text FROM steps), "
    "led AS (SELECT *, lead(us) OVER (PARTITION BY conv_id ORDER BY us) AS next FROM changes), "
    "quiet AS (SELECT conv_id, us, trim(text, chr(32) || chr(9) || chr(10)) AS text FROM led WHERE next IS NULL OR next - us >= 1500000), "
    "lagged AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY us) AS before FROM quiet WHERE length(text) >= 20), "
    "gated AS (SELECT conv_id, us AS turn, text FROM lagged WHERE before IS NULL OR before <> text), "
    "first_write AS (SELECT conv_id, token, min(1704067200000000 + conv_id * 3600000000 + turn * 30000000) AS us FROM vault GROUP BY ALL), "
    f"{oracle.response_hits('gated').replace('hits AS', 'found AS', 1)}, "
    "echoes AS (SELECT g.conv_id, g.turn, f.token FROM gated g JOIN first_write f ON f.conv_id = g.conv_id AND f.us < g.turn AND contains(g.text, f.token)), "
    "w AS (SELECT conv_id, turn, 'TOKEN_ECHO' AS type, token AS value, 'AI echoed the redaction token ' || token || ' in its response' AS reason FROM echoes "
    "UNION ALL SELECT conv_id, turn, 'PII_IN_RESPONSE', value, 'AI response contains what looks like a ' || type FROM found) "
    "SELECT g.conv_id, g.turn AS us, EXISTS (SELECT 1 FROM echoes e WHERE e.conv_id = g.conv_id AND e.turn = g.turn) AS token_echo, "
    "w.type, w.value, w.reason FROM gated g LEFT JOIN w ON w.conv_id = g.conv_id AND w.turn = g.turn"
)
register("answer_flow", lambda spark, sf: flow_rows(scan_updates(updates(spark, sf), prompt_tokens(spark, sf))), ANSWER_FLOW)


def _debounce_events(spark: SparkSession, sf: str) -> DataFrame:
    """Five event types only: every key is hot."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", "ts")
    kept = debounce_responses(events, key="event_type", gap_ms=60_000)
    return kept.select("event_type", "event_id")


register(
    "debounce_events",
    _debounce_events,
    "SELECT event_type, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next FROM events) "
    "WHERE next IS NULL OR epoch_us(next) - epoch_us(ts) >= 60000000",
)
