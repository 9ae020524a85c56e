"""Queries of the audit log, its statistics and the detector quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.hashing import prompt_hash
from maskwright.functions.text import utf16_length
from maskwright.operators.audit import (
    audit_entries, audit_json, audit_report, detector_quality, recent, retained, session_stats,
)
from maskwright.operators.detect import detect
from maskwright.operators.responses import pii_warnings
from maskwright.operators.review import distinct_types
from maskwright.plans import oracle
from maskwright.plans.catalog import documents, register
from maskwright.plans.gating import SANITIZED_REF, prompts
from maskwright.plans.seed import SEEDED_TYPES
from maskwright.plans.sessions import sanitized
from maskwright.policy import Policy
from maskwright.rules import BUILT_IN
from maskwright.session import work_dir
from maskwright.sources.tables import append_audit, purge_audit, read_audit

# "Now" of the retention query: 30 days and 4 hours after the first seeded turn.
NOW_MS = 1704067200000 + 30 * 86_400_000 + 4 * 3_600_000


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_entries(sanitized(spark, sf), ["conv_id", "turn"])


def _hash_sql(text: str) -> str:
    return (
        f"to_hex(list_reduce(list_prepend(5381::UBIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::UBIGINT)), "
        "lambda h, c: (h * 33 + c) % 4294967296))"
    )


_ID = (
    "array_to_string(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda p: "
    "substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((epoch_ms(s.ts) // CAST(pow(36, p) AS BIGINT)) % 36 AS INTEGER) + 1, 1)), '') "
    "|| array_to_string(list_transform([3, 2, 1, 0], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST("
    "(CAST('0x' || substr(md5(CAST(s.conv_id AS VARCHAR) || '|' || CAST(s.turn AS VARCHAR)), 1, 12) AS BIGINT) "
    "// CAST(pow(36, p) AS BIGINT)) % 36 AS INTEGER) + 1, 1)), '')"
)
AUDIT = (
    f"{SANITIZED_REF}, type_firsts AS (SELECT conv_id, turn, type, min(seq) AS seq FROM dets GROUP BY ALL), "
    "type_lists AS (SELECT conv_id, turn, list(type ORDER BY seq) AS pii_types FROM type_firsts GROUP BY ALL), "
    f"audit AS (SELECT {_ID} AS id, s.ts, "
    f"lower({_hash_sql('s.text')}) AS prompt_hash, "
    "CAST(length(s.text) AS BIGINT) AS prompt_length, coalesce(t.pii_types, []) AS pii_types, CAST(s.pii_count AS INTEGER) AS pii_count, "
    "s.domain, CAST(s.ts AS DATE) AS day FROM sanitized s LEFT JOIN type_lists t ON s.conv_id = t.conv_id AND s.turn = t.turn "
    "WHERE s.scanned)"
)

register(
    "prompt_hash",
    lambda spark, sf: documents(spark, sf).select(
        "doc_id", prompt_hash(F.col("text")).alias("prompt_hash"), utf16_length(F.col("text")).alias("prompt_length")
    ),
    f"SELECT doc_id, lower({_hash_sql('text')}) AS prompt_hash, CAST(length(text) AS BIGINT) AS prompt_length FROM documents",
)
register(
    "audit",
    lambda spark, sf: audit(spark, sf).select(
        "id", F.unix_millis("ts").alias("ts_ms"), "prompt_hash", "prompt_length",
        F.array_join("pii_types", ",").alias("pii_types"), "pii_count", "domain", F.col("day").cast("string").alias("day"),
    ),
    f"WITH {AUDIT} SELECT id, epoch_ms(ts) AS ts_ms, prompt_hash, prompt_length, array_to_string(pii_types, ',') AS pii_types, "
    "pii_count, domain, CAST(day AS VARCHAR) AS day FROM audit",
)
register(
    "audit_json",
    lambda spark, sf: audit_json(audit(spark, sf)),
    f"""WITH {AUDIT} SELECT id, '{{"id":"' || id || '","timestamp":' || epoch_ms(ts) || ',"promptHash":"' || prompt_hash
    || '","promptLength":' || prompt_length || ',"piiTypes":[' || array_to_string(list_transform(pii_types, lambda t: '"' || t || '"'), ',')
    || '],"piiCount":' || pii_count || ',"elapsedMs":null,"domain":"' || domain || '"}}' AS json FROM audit""",
)
register(
    "audit_recent",
    lambda spark, sf: recent(audit(spark, sf), 50).select("id", F.unix_millis("ts").alias("ts_ms"), "domain", "pii_count"),
    f"WITH {AUDIT} SELECT id, epoch_ms(ts) AS ts_ms, domain, pii_count FROM audit ORDER BY ts DESC, id DESC LIMIT 50",
)
register(
    "retention",
    lambda spark, sf: retained(audit(spark, sf), NOW_MS).select("id", F.unix_millis("ts").alias("ts_ms")),
    f"WITH {AUDIT} SELECT id, epoch_ms(ts) AS ts_ms FROM audit WHERE epoch_ms(ts) >= {NOW_MS - 30 * 86_400_000}",
)


def _purged(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a table, from which a job has removed the days that are too old."""
    path = work_dir(spark, "audit")
    append_audit(audit(spark, sf), path)
    purge_audit(spark, path, Policy(audit_retention_days=3), NOW_MS - 27 * 86_400_000)
    return read_audit(spark, path).select("id", F.col("day").cast("string").alias("day"))


register(
    "audit_purge",
    _purged,
    f"WITH {AUDIT} SELECT id, CAST(day AS VARCHAR) AS day FROM audit WHERE day >= CAST(make_timestamp({NOW_MS - 30 * 86_400_000} * 1000) AS DATE)",
)
STATS = "SELECT count(*) AS prompts_processed, CAST(coalesce(sum(pii_count), 0) AS BIGINT) AS pii_caught FROM sanitized WHERE scanned"
register("session_stats", lambda spark, sf: session_stats(sanitized(spark, sf)), f"WITH {SANITIZED_REF} {STATS}")
register(
    "audit_report",
    lambda spark, sf: audit_report(audit(spark, sf)).withColumn("day", F.col("day").cast("string")),
    f"WITH {AUDIT}, typed AS (SELECT CAST(day AS VARCHAR) AS day, domain, unnest(pii_types) AS type FROM audit) "
    "SELECT domain, type, day, count(*) AS entries FROM typed GROUP BY CUBE (domain, type, day)",
)

TYPES = [r.type for r in BUILT_IN]


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    """Detections in the seeded prompts against what was put into them."""
    labels = F.array(*[F.array(*[F.lit(t) for t in ts]).cast("array<string>") for ts in SEEDED_TYPES])
    case = ((F.col("conv_id") * 5 + F.col("turn")) % 13).cast("int")
    return detector_quality(
        detect(prompts(spark, sf)), distinct_types(F.col("detections")), F.get(labels, case), TYPES
    )


_LABELS = "[" + ", ".join("[" + ", ".join(f"'{t}'" for t in ts) + "]::VARCHAR[]" for ts in SEEDED_TYPES) + "]"
register(
    "sample_quality",
    _quality,
    f"WITH {oracle.SEEDED}, prompts AS (SELECT * FROM seeded WHERE role = 'user'), {oracle.detections('prompts', oracle.TURN_KEYS)}, "
    f"flags AS (SELECT t.type, EXISTS (SELECT 1 FROM dets d WHERE d.conv_id = p.conv_id AND d.turn = p.turn AND d.type = t.type) AS p, "
    f"list_contains(({_LABELS})[CAST((p.conv_id * 5 + p.turn) % 13 AS INTEGER) + 1], t.type) AS e "
    f"FROM prompts p, (SELECT unnest({TYPES}) AS type) t) "
    "SELECT type, count(*) FILTER (p AND e) AS true_positives, count(*) FILTER (p AND NOT e) AS false_positives, "
    "count(*) FILTER (NOT p AND e) AS false_negatives, count(*) FILTER (NOT p AND NOT e) AS true_negatives, "
    'CAST(count(*) FILTER (p AND e) AS DOUBLE) / nullif(count(*) FILTER (p), 0) AS "precision", '
    "CAST(count(*) FILTER (p AND e) AS DOUBLE) / nullif(count(*) FILTER (e), 0) AS recall, "
    "CAST(count(*) FILTER (p AND NOT e) AS DOUBLE) / nullif(count(*) FILTER (NOT e), 0) AS false_positive_rate "
    "FROM flags GROUP BY type",
)


def _false_positives(spark: SparkSession, sf: str) -> DataFrame:
    """Share of documents, by language, in which a response scan would see personal data."""
    docs = documents(spark, sf, "lang", "text")
    flagged = docs.select("lang", (F.size(pii_warnings(F.col("text"))) > 0).cast("int").alias("flag"))
    return flagged.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("flag").alias("flagged"), F.avg("flag").alias("rate"))


_FIVE = " OR ".join(
    f"regexp_matches(text, {oracle.quote(r.re2)})" for r in BUILT_IN if r.type in ("EMAIL", "SSN", "CREDIT_CARD", "IBAN", "PASSPORT")
)
register(
    "false_positive_rate",
    _false_positives,
    "SELECT lang, count(*) AS texts, CAST(sum(flag) AS BIGINT) AS flagged, avg(flag) AS rate "
    f"FROM (SELECT lang, CASE WHEN {_FIVE} THEN 1 ELSE 0 END AS flag FROM documents) GROUP BY lang",
)
