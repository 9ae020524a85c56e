"""Queries that run the streaming jobs over files and return what they wrote.

The turns are first written as files in order of time, several per
conversation, and read a slice per micro-batch, so what is remembered has to carry over.
All folders lie below the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import schemas
from maskwright.plans import oracle
from maskwright.plans.auditing import AUDIT, STATS
from maskwright.plans.catalog import register
from maskwright.plans.gating import SANITIZED_REF, SANITIZED_SAFE, SANITIZED_STREAM, allowlist
from maskwright.plans.seed import DUCKDB_SQL, seeded_turns
from maskwright.operators.vault import restore
from maskwright.plans.sessions import ANSWER_FLOW, CHANGED, DEBOUNCED, flow_rows, prompt_tokens, repeating, updates
from maskwright.session import cut_lineage, work_dir
from maskwright.sources.tables import append_audit, read_audit, write_token_vault
from maskwright.streaming import flow

SLICES = 3
FILES = 4


def turn_files(spark: SparkSession, sf: str, late: bool = False) -> str:
    """Seeded turns as files in their order of time: first turns of all conversations, then the following ones.

    With ``late`` the slices arrive the other way round, so that answers come before the prompts they quote, and a close
    event follows.
    """
    path = work_dir(spark, "turns")
    turns = seeded_turns(spark, sf).select("conv_id", "turn", "role", "text", "domain", "ts")
    for i in reversed(range(SLICES)) if late else range(SLICES):
        part = turns.where(F.least(F.floor(F.col("turn") / 2), F.lit(SLICES - 1)) == i)
        part.repartition(FILES).write.mode("append").parquet(path)
    return path


def stream(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    return flow.read_stream(spark, turn_files(spark, sf, late), schemas.TURNS, files_per_batch=FILES)


def conversations(spark: SparkSession, turns: DataFrame, **options) -> str:
    """Run the conversation job over everything there is; the folder of its tables."""
    out = work_dir(spark, "conversations")
    flow.conversation_stream(turns, f"{out}/tables", f"{out}/checkpoint", allowlist=allowlist(spark), **options).awaitTermination()
    return f"{out}/tables"


def written(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything there is and read its output back."""
    out = work_dir(spark, name)
    flow.run_available(result, f"{out}/data", f"{out}/checkpoint")
    return spark.read.schema(result.schema).parquet(f"{out}/data")


def _sanitize(spark: SparkSession, sf: str) -> DataFrame:
    result = flow.sanitize_stream(stream(spark, sf), allowlist=allowlist(spark)).select(
        "conv_id", "turn", "scanned", "sanitized", F.col("pii_count").cast("long").alias("pii_count"),
        F.size("semantic_hits").cast("long").alias("hints"),
    )
    return written(spark, result, "sanitized")


register(
    "stream_sanitize",
    _sanitize,
    f"WITH {SANITIZED_STREAM} SELECT conv_id, turn, scanned, sanitized, pii_count, hints FROM sanitized",
)

_VAULT = f"{SANITIZED_SAFE}, vault AS (SELECT conv_id, turn, seq, token, value FROM labelled)"
_ANSWERS = "answers AS (SELECT conv_id, turn, text FROM seeded WHERE role = 'assistant')"
_HELD = (
    "held AS (SELECT a.conv_id, a.turn, v.token, arg_max(v.value, v.turn) AS value FROM answers a JOIN vault v "
    "ON v.conv_id = a.conv_id AND v.turn < a.turn AND contains(a.text, v.token) GROUP BY ALL)"
)


def _held_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return flow.held_tokens(spark, conversations(spark, stream(spark, sf)))


register(
    "stream_vault", _held_tokens, f"WITH {_VAULT}, {_ANSWERS}, {_HELD} SELECT conv_id, turn, token, value FROM held"
)


def _closing(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations are closed at turn 2; answers after that find no older token."""
    turns = stream(spark, sf)
    closed = turns.where(F.col("turn") == 2).withColumns({"role": F.lit("close"), "text": F.lit(None).cast("string")})
    return flow.held_tokens(spark, conversations(spark, turns.unionByName(closed)))


register(
    "stream_closed_sessions",
    _closing,
    f"WITH {_VAULT}, {_ANSWERS}, closed AS (SELECT DISTINCT conv_id FROM seeded WHERE turn = 2), "
    "held AS (SELECT a.conv_id, a.turn, v.token, arg_max(v.value, v.turn) AS value FROM answers a JOIN vault v "
    "ON v.conv_id = a.conv_id AND v.turn < a.turn AND contains(a.text, v.token) "
    "AND NOT (v.turn <= 2 AND a.turn > 2 AND a.conv_id IN (SELECT conv_id FROM closed)) GROUP BY ALL) "
    "SELECT conv_id, turn, token, value FROM held",
)


#: In the seeded turns, conversations are an hour apart and their turns half a minute.
BOUND = "40 hours"
_BOUND_US = 40 * 3600 * 1_000_000


def _expired(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that have been idle for ``BOUND`` lose their tokens, and start again at 1 if they go on."""
    root = conversations(spark, stream(spark, sf), timeout=BOUND, merge=1)
    return flow.held_tokens(spark, root)


# A conversation that goes on after its end is one of its own: its number times 8 plus the ends so far.
_SEGMENTED = (
    f"raw AS ({DUCKDB_SQL}), sliced AS (SELECT *, least(turn // 2, {SLICES - 1}) AS slice FROM raw), "
    "clock AS (SELECT slice, max(max(epoch_us(ts))) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM sliced GROUP BY slice), "
    "touched AS (SELECT conv_id, slice, max(max(epoch_us(ts))) OVER (PARTITION BY conv_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before "
    "FROM sliced GROUP BY conv_id, slice), "
    f"segments AS (SELECT conv_id, slice, count(*) FILTER (before < now - {_BOUND_US}) OVER (PARTITION BY conv_id ORDER BY slice) AS segment "
    "FROM touched JOIN clock USING (slice)), "
    "seeded AS (SELECT conv_id * 8 + segment AS conv_id, turn, role, domain, ts, text FROM sliced JOIN segments USING (conv_id, slice))"
)
register(
    "stream_expired_sessions",
    _expired,
    f"WITH {_VAULT}, {_ANSWERS}, {_HELD} SELECT conv_id // 8 AS conv_id, turn, token, value FROM held".replace(oracle.SEEDED, _SEGMENTED),
)


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    tables = flow.Tables(conversations(spark, stream(spark, sf)))
    return tables.read(spark, "warnings", flow.WARNINGS).select("conv_id", "turn", "type", "value", "reason")


register(
    "stream_scan_responses",
    _scan,
    f"WITH {_VAULT}, {_ANSWERS}, {_HELD}, {oracle.response_hits('answers').replace('hits AS', 'found AS', 1)} "
    "SELECT conv_id, turn, 'TOKEN_ECHO' AS type, token AS value, "
    "'AI echoed the redaction token ' || token || ' in its response' AS reason FROM held UNION ALL "
    "SELECT conv_id, turn, 'PII_IN_RESPONSE', value, 'AI response contains what looks like a ' || type FROM found",
)


def _late(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that arrive the wrong way round: the vault still restores every prompt, and the rows are listed as late."""
    tables = flow.Tables(conversations(spark, stream(spark, sf, late=True)))
    done = tables.read(spark, "sanitized", "conv_id long, turn long, sanitized string")
    quoted = done.select("conv_id", (F.col("turn") + 1_000_000).alias("turn"), F.col("sanitized").alias("text"))
    back = restore(quoted, flow.stream_vault(spark, tables.root)).select("conv_id", (F.col("turn") - 1_000_000).alias("turn"), "restored")
    late = tables.read(spark, "late", flow.LATE).select("conv_id", "turn", F.lit(True).alias("late"))
    return back.join(late, ["conv_id", "turn"], "left").withColumn("late", F.coalesce("late", F.lit(False)))


register(
    "stream_late",
    _late,
    f"WITH {oracle.SEEDED}, sliced AS (SELECT *, least(turn // 2, {SLICES - 1}) AS slice FROM seeded), "
    "latest AS (SELECT conv_id, max(slice) AS slice FROM sliced GROUP BY ALL) "
    "SELECT s.conv_id, s.turn, s.text AS restored, s.slice < l.slice AS late FROM sliced s JOIN latest l USING (conv_id) "
    "WHERE role = 'user' AND trim(text) <> ''",
)


def _too_late(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that arrive the wrong way round: those older than ``BOUND`` are listed, the others are processed."""
    tables = flow.Tables(conversations(spark, stream(spark, sf, late=True), lateness=BOUND, merge=2))
    missed = tables.read(spark, "too_late", flow.TOO_LATE).select("conv_id", "turn", "role", F.lit(True).alias("too_late"))
    done = tables.read(spark, "sanitized", "conv_id long, turn long, sanitized string")
    quoted = done.select("conv_id", (F.col("turn") + 1_000_000).alias("turn"), F.col("sanitized").alias("text"))
    back = restore(quoted, flow.stream_vault(spark, tables.root)).select("conv_id", (F.col("turn") - 1_000_000).alias("turn"), "restored")
    processed = back.select("conv_id", "turn", F.lit("user").alias("role"), F.lit(False).alias("too_late"), "restored")
    return missed.withColumn("restored", F.lit(None).cast("string")).unionByName(processed)


register(
    "stream_too_late",
    _too_late,
    f"WITH {oracle.SEEDED}, sliced AS (SELECT *, least(turn // 2, {SLICES - 1}) AS slice FROM seeded), "
    "clock AS (SELECT slice, max(max(epoch_us(ts))) OVER (ORDER BY slice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM sliced GROUP BY slice), "
    f"judged AS (SELECT s.*, coalesce(epoch_us(ts) < now - {_BOUND_US}, false) AS too_late FROM sliced s JOIN clock USING (slice)) "
    "SELECT conv_id, turn, role, too_late, CASE WHEN NOT too_late THEN text END AS restored FROM judged "
    "WHERE too_late OR (role = 'user' AND trim(text) <> '')",
)


def _skip_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """Whole answers, of which every second repeats the first of its conversation."""
    out = work_dir(spark, "changed")
    answers = flow.read_stream(spark, _repeating_files(spark, sf), "conv_id long, turn long, text string", files_per_batch=FILES)
    flow.changed_answers(answers, f"{out}/tables", f"{out}/checkpoint").awaitTermination()
    return flow.Tables(f"{out}/tables").read(spark, "changed", "conv_id long, turn long, text string").select("conv_id", "turn", "text")


def _repeating_files(spark: SparkSession, sf: str) -> str:
    path, answers = work_dir(spark, "answers"), repeating(spark, sf)
    for i in range(SLICES):
        part = answers.where(F.least(F.floor(F.col("turn") / 4), F.lit(SLICES - 1)) == i)
        part.repartition(FILES).write.mode("append").parquet(path)
    return path


register("stream_skip_unchanged", _skip_unchanged, CHANGED)


def _debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Changes as a stream; a closing event far in the future lets the last period end."""
    path = work_dir(spark, "updates")
    changes = updates(spark, sf)
    changes.write.mode("append").parquet(path)
    end = changes.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("conv_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("").alias("text")
    )
    end.write.mode("append").parquet(path)
    changed = flow.read_stream(spark, path, "conv_id long, ts timestamp, text string", lateness="10 seconds")
    done = written(spark, flow.debounce_stream(changed), "debounced")
    return done.where(F.col("conv_id") >= 0).select("conv_id", F.unix_micros("ts").alias("us"), "text")


register("stream_debounce", _debounce, DEBOUNCED)


def _answer_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Changes in order of time, a part of the conversations per micro-batch, through the whole flow in one query."""
    path, out = work_dir(spark, "updates"), work_dir(spark, "answers")
    changes = updates(spark, sf)
    most = changes.agg(F.max("conv_id").alias("n"), F.max("ts").alias("ts")).first()
    for i in range(SLICES):
        part = changes.where(F.floor(F.col("conv_id") * SLICES / (most.n + 1)) == i)
        part.repartition(FILES).write.mode("append").parquet(path)
    end = changes.limit(1).select(F.lit(-1).cast("long").alias("conv_id"), F.expr(f"timestamp'{most.ts}' + INTERVAL 1 DAY").alias("ts"), F.lit("").alias("text"))
    end.write.mode("append").parquet(path)
    changed = flow.read_stream(spark, path, "conv_id long, ts timestamp, text string", files_per_batch=FILES, lateness="10 seconds")
    vault = cut_lineage(prompt_tokens(spark, sf))
    flow.answer_stream(changed, lambda: vault, f"{out}/tables", f"{out}/checkpoint").awaitTermination()
    return flow_rows(flow.Tables(f"{out}/tables").read(spark, "scanned", flow.SCANNED))


register("stream_answer_flow", _answer_flow, ANSWER_FLOW)


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    result = flow.running_stats(flow.sanitize_stream(stream(spark, sf), allowlist=allowlist(spark), mode="reference"))
    out = work_dir(spark, "stats")
    flow.write_counters(result, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return flow.latest_counters(spark, f"{out}/data")


register("stream_session_stats", _stats, f"WITH {SANITIZED_REF} {STATS}")


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    result = flow.audit_stream(flow.sanitize_stream(stream(spark, sf), allowlist=allowlist(spark), mode="reference"))
    out = work_dir(spark, "audit")
    flow.run_available(result, f"{out}/data", f"{out}/checkpoint", partition_by=("day",))
    return read_audit(spark, f"{out}/data").select(
        "prompt_hash", "prompt_length", F.array_join("pii_types", ",").alias("pii_types"), "pii_count", "domain"
    )


register(
    "stream_audit",
    _audit,
    f"WITH {AUDIT} SELECT prompt_hash, prompt_length, array_to_string(pii_types, ',') AS pii_types, pii_count, domain FROM audit",
)


def _sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Vault and log written as tables and read back."""
    from maskwright.plans.auditing import audit
    from maskwright.plans.sessions import vault

    out = work_dir(spark, "sinks")
    write_token_vault(vault(spark, sf), f"{out}/vault")
    append_audit(audit(spark, sf), f"{out}/audit")
    tokens = spark.read.parquet(f"{out}/vault").select(F.lit("vault").alias("sink"), F.col("token").alias("name"))
    entries = read_audit(spark, f"{out}/audit").select(F.lit("audit"), "domain")
    return tokens.union(entries).groupBy("sink", "name").agg(F.count("*").alias("n"))


register(
    "sinks",
    _sinks,
    f"WITH {AUDIT}, vault AS (SELECT token FROM labelled) SELECT 'vault' AS sink, token AS name, count(*) AS n FROM vault GROUP BY ALL "
    "UNION ALL SELECT 'audit', domain, count(*) FROM audit GROUP BY ALL",
)
