"""Queries of the rewriting and review jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import preview
from maskwright.operators.detect import detect, explode_detections
from maskwright.operators.padding import jitter_timestamps, pad_texts
from maskwright.operators.redact import explode_tokens, redact
from maskwright.operators.review import (
    DECISIONS, DETECTION_PREVIEW, TOKEN_PREVIEW, action_of, diff_segments, high_risk_flag, high_risk_types, outgoing,
    severity, severity_label,
)
from maskwright.operators.synthesize import synthesize
from maskwright.operators.vault import redact_conversations, restore_with_map, synthesize_conversations
from maskwright.operators.redact import token_map
from maskwright.plans import oracle
from maskwright.plans.catalog import corpus, documents, register
from maskwright.plans.seed import seeded_turns

KEYS = list(oracle.CORPUS_KEYS)
TURN = list(oracle.TURN_KEYS)
_CORPUS_REF = (
    f"WITH {oracle.CORPUS}, {oracle.detections('corpus', oracle.CORPUS_KEYS)}, {oracle.numbered(oracle.CORPUS_KEYS)}"
)
_CORPUS_SAFE = (
    f"WITH {oracle.CORPUS}, {oracle.covers('corpus', oracle.CORPUS_KEYS)}, {oracle.numbered(oracle.CORPUS_KEYS, source='corpus')}"
)
_TURNS_REF = (
    f"WITH {oracle.SEEDED}, {oracle.detections('seeded', oracle.TURN_KEYS)}, {oracle.numbered(oracle.TURN_KEYS)}"
)


def _redact_ref(spark: SparkSession, sf: str) -> DataFrame:
    done = redact(detect(corpus(spark, sf)), mode="reference")
    return done.select(*KEYS, F.size("detections").cast("long").alias("pii_count"), "sanitized")


register(
    "redact_ref",
    _redact_ref,
    f"{_CORPUS_REF}, {oracle.rewritten('corpus', oracle.CORPUS_KEYS)} "
    "SELECT src, id, sub, n_spans AS pii_count, sanitized FROM rewritten",
)


def _redact_safe(spark: SparkSession, sf: str) -> DataFrame:
    done = redact(detect(corpus(spark, sf), occurrences="all"), mode="safe")
    return done.select(*KEYS, F.size("tokens").cast("long").alias("pii_count"), "sanitized")


register(
    "redact_safe",
    _redact_safe,
    f"{_CORPUS_SAFE}, {oracle.rewritten('corpus', oracle.CORPUS_KEYS)} "
    "SELECT src, id, sub, n_values AS pii_count, sanitized FROM rewritten",
)
register(
    "token_map",
    lambda spark, sf: explode_tokens(redact(detect(corpus(spark, sf)), mode="reference"), KEYS),
    f"{_CORPUS_REF} SELECT src, id, sub, seq, token, value, type FROM labelled",
)


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    done = redact(detect(corpus(spark, sf), occurrences="all"), mode="safe")
    back = done.withColumn("restored", restore_with_map(F.col("sanitized"), token_map(F.col("tokens"))))
    return back.select(*KEYS, "restored")


register("restore_round_trip", _round_trip, f"WITH {oracle.CORPUS} SELECT src, id, sub, text AS restored FROM corpus")


def _redact_conversation(spark: SparkSession, sf: str) -> DataFrame:
    turns = seeded_turns(spark, sf).select(*TURN, "text")
    done = redact_conversations(detect(turns, occurrences="all"))
    return done.select(*TURN, "sanitized")


register(
    "redact_conversation",
    _redact_conversation,
    f"WITH {oracle.SEEDED}, {oracle.covers('seeded', oracle.TURN_KEYS)}, "
    f"{oracle.numbered(oracle.TURN_KEYS, source='seeded', group=('conv_id',))}, "
    f"{oracle.rewritten('seeded', oracle.TURN_KEYS)} SELECT conv_id, turn, sanitized FROM rewritten",
)
register(
    "synthesize_conversation",
    lambda spark, sf: synthesize_conversations(
        detect(seeded_turns(spark, sf).select(*TURN, "text"), occurrences="all"), seed=7
    ).select(*TURN, "sanitized"),
    f"WITH {oracle.SEEDED}, {oracle.covers('seeded', oracle.TURN_KEYS)}, "
    f"{oracle.numbered(oracle.TURN_KEYS, oracle.fake_label(('conv_id',), 7, 'safe'), 'seeded', ('conv_id',))}, "
    f"{oracle.rewritten('seeded', oracle.TURN_KEYS)} SELECT conv_id, turn, sanitized FROM rewritten",
)


def _synthesize(mode: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = detect(corpus(spark, sf), occurrences="all" if mode == "safe" else "first")
        return synthesize(found, KEYS, seed=7, mode=mode).select(*KEYS, "sanitized")

    return run


for _mode, _name, _spans in (("reference", "synthesize_ref", oracle.detections), ("safe", "synthesize", oracle.covers)):
    register(
        _name,
        _synthesize(_mode),
        f"WITH {oracle.CORPUS}, {_spans('corpus', oracle.CORPUS_KEYS)}, "
        f"{oracle.numbered(oracle.CORPUS_KEYS, oracle.fake_label(oracle.CORPUS_KEYS, 7, _mode), 'corpus' if _mode == 'safe' else '')}, "
        f"{oracle.rewritten('corpus', oracle.CORPUS_KEYS)} SELECT src, id, sub, sanitized FROM rewritten",
    )


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    return redact(detect(seeded_turns(spark, sf)), mode="reference")


_RISKY = "type IN ('SSN', 'PASSPORT', 'IBAN', 'CREDIT_CARD')"
_FLAGS = (
    f"flags AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (WHERE {_RISKY}) AS risky FROM dets GROUP BY conv_id, turn)"
)

register(
    "high_risk",
    lambda spark, sf: _scanned(spark, sf).select(*TURN, high_risk_flag(F.col("detections")).alias("high_risk")),
    f"{_TURNS_REF}, {_FLAGS} SELECT s.conv_id, s.turn, coalesce(risky, 0) > 0 AS high_risk "
    "FROM seeded s LEFT JOIN flags f ON s.conv_id = f.conv_id AND s.turn = f.turn",
)
register(
    "high_risk_types",
    lambda spark, sf: _scanned(spark, sf).select(
        *TURN, F.array_join(high_risk_types(F.col("detections")), ",").alias("types")
    ),
    f"{_TURNS_REF}, firsts_of AS (SELECT conv_id, turn, type, min(seq) AS seq FROM dets WHERE {_RISKY} GROUP BY ALL), "
    "per AS (SELECT conv_id, turn, string_agg(type, ',' ORDER BY seq) AS types FROM firsts_of GROUP BY ALL) "
    "SELECT s.conv_id, s.turn, coalesce(types, '') AS types FROM seeded s LEFT JOIN per p "
    "ON s.conv_id = p.conv_id AND s.turn = p.turn",
)


def _route(spark: SparkSession, sf: str) -> DataFrame:
    """All three decisions over one scan."""
    text, done = F.col("text"), _scanned(spark, sf)
    decided = done.select(
        *TURN,
        F.explode(
            F.array(*[
                F.struct(F.lit(d).alias("decision"), action_of(F.col("detections"), d).alias("action"), outgoing(action_of(F.col("detections"), d), text).alias("outgoing"))
                for d in DECISIONS
            ])
        ).alias("r"),
    )
    return decided.select("r.decision", *TURN, "r.action", "r.outgoing")


register(
    "route",
    _route,
    f"{_TURNS_REF}, {_FLAGS}, {oracle.rewritten('seeded', oracle.TURN_KEYS)}, "
    "decided AS (SELECT d.decision, s.conv_id, s.turn, s.text, s.sanitized, CASE WHEN coalesce(risky, 0) > 0 THEN d.taken "
    "WHEN coalesce(n, 0) > 0 THEN 'redacted' ELSE 'clean' END AS action "
    "FROM rewritten s LEFT JOIN flags f ON s.conv_id = f.conv_id AND s.turn = f.turn, "
    "(VALUES ('redact', 'redacted'), ('original', 'original'), ('quarantine', 'quarantined')) AS d(decision, taken)) "
    "SELECT decision, conv_id, turn, action, CASE action WHEN 'original' THEN text WHEN 'quarantined' THEN NULL "
    "ELSE sanitized END AS outgoing FROM decided",
)


def _severity(spark: SparkSession, sf: str) -> DataFrame:
    counted = detect(corpus(spark, sf)).withColumn("pii_count", F.size("detections"))
    count = F.col("pii_count")
    return counted.select(
        *KEYS, count.cast("long").alias("pii_count"), severity(count).alias("severity"), severity_label(count).alias("label")
    )


register(
    "severity",
    _severity,
    f"{_CORPUS_REF}, per AS (SELECT src, id, sub, count(*) AS n FROM dets GROUP BY ALL), "
    "sized AS (SELECT c.src, c.id, c.sub, coalesce(n, 0) AS pii_count FROM corpus c LEFT JOIN per p "
    "ON c.src = p.src AND c.id = p.id AND c.sub = p.sub) "
    "SELECT src, id, sub, pii_count, CASE WHEN pii_count = 0 THEN 'clean' WHEN pii_count < 4 THEN 'amber' ELSE 'red' END AS severity, "
    "CASE WHEN pii_count = 0 THEN '✓ Clean' WHEN pii_count = 1 THEN '🔒 1 item redacted' "
    "ELSE '🔒 ' || CAST(pii_count AS VARCHAR) || ' items redacted' END AS label FROM sized",
)


def _preview(spark: SparkSession, sf: str) -> DataFrame:
    """Every value and, as number -1, the text, over one scan."""
    shown = F.concat(
        F.array(F.struct(F.lit(-1).alias("seq"), F.col("text").alias("value"))),
        F.transform("detections", lambda d, i: F.struct(i.alias("seq"), d["value"].alias("value"))),
    )
    rows = detect(corpus(spark, sf)).select(*KEYS, F.explode(shown).alias("s"))
    return rows.select(
        *KEYS,
        "s.seq",
        preview(F.col("s.value"), DETECTION_PREVIEW).alias("detection"),
        preview(F.col("s.value"), TOKEN_PREVIEW).alias("token_value"),
    )


register(
    "preview",
    _preview,
    f"{_CORPUS_REF}, shown AS (SELECT src, id, sub, seq, value FROM dets UNION ALL "
    "SELECT src, id, sub, CAST(-1 AS INTEGER), text FROM corpus) SELECT src, id, sub, seq, "
    "CASE WHEN length(value) > 40 THEN left(value, 40) || '…' ELSE value END AS detection, "
    "CASE WHEN length(value) > 32 THEN left(value, 32) || '…' ELSE value END AS token_value FROM shown",
)
register(
    "diff_segments",
    lambda spark, sf: diff_segments(redact(detect(corpus(spark, sf)), mode="reference"), KEYS),
    f"{_CORPUS_REF}, {oracle.rewritten('corpus', oracle.CORPUS_KEYS)}, "
    "cuts AS (SELECT src, id, sub, 2 * seq AS pos, 'plain' AS kind, "
    "substring(text, cursor + 1, greatest(start - cursor, 0)) AS text FROM pieces "
    "UNION ALL SELECT src, id, sub, 2 * seq + 1, 'pii', value FROM pieces "
    'UNION ALL SELECT src, id, sub, 1000000, \'plain\', substring(first(text), CAST(arg_max("end", seq) AS INTEGER) + 1) '
    "FROM pieces GROUP BY src, id, sub "
    "UNION ALL SELECT src, id, sub, 0, 'plain', text FROM rewritten WHERE n_spans = 0), "
    "tokens AS (SELECT src, id, sub, regexp_extract_all(sanitized, '\\[[A-Z_]+_\\d+\\]') AS m, "
    "string_split_regex(sanitized, '\\[[A-Z_]+_\\d+\\]') AS g FROM rewritten), "
    "marks AS (SELECT src, id, sub, 2 * i AS pos, 'plain' AS kind, g[i] AS text FROM "
    "(SELECT *, unnest(range(1, len(g) + 1)) AS i FROM tokens) UNION ALL "
    "SELECT src, id, sub, 2 * i + 1, 'token', m[i] FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM tokens)), "
    "sides AS (SELECT 'original' AS side, * FROM cuts UNION ALL SELECT 'sanitized', * FROM marks) "
    "SELECT src, id, sub, side, CAST(row_number() OVER (PARTITION BY src, id, sub, side ORDER BY pos) - 1 AS INTEGER) AS seq, "
    "kind, text FROM sides WHERE text <> ''",
)


def _pad(spark: SparkSession, sf: str) -> DataFrame:
    return pad_texts(documents(spark, sf)).select("doc_id", F.col("words").cast("long").alias("words"), "padded")


register(
    "pad_to_bucket",
    _pad,
    "SELECT doc_id, words, text || repeat(' ', CAST((256 - words % 256) % 256 AS INTEGER)) AS padded FROM "
    "(SELECT doc_id, text, CAST(len(string_split_regex(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), '\\s+')) "
    "AS BIGINT) AS words FROM documents)",
)


def _jitter(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    moved = jitter_timestamps(events, ["event_id"], seed=7)
    return moved.select("event_id", F.unix_micros("ts_jittered").alias("us"))


register(
    "jitter",
    _jitter,
    "SELECT event_id, epoch_us(ts) + 50000 + CAST('0x' || substr(md5('7|' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 200000 AS us "
    "FROM events",
)
