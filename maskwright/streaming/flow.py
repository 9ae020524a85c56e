"""The same jobs on streams of turns.

Stateless steps are the batch projections.  What a conversation remembers is
kept in tables that every micro-batch reads and adds to, not in the memory of a
keyed operator: the batch jobs, which split large conversations by ranges of
turns, then do the work, other jobs can read the token vault, and turns may come
in any order.  What is read again (``state.State``) is a snapshot and the folders of
a few batches, merged from time to time into a new snapshot without what has
ended; what is only written has a folder for each micro-batch.  A repeated
batch overwrites its folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from maskwright.functions.text import at_least, strip
from maskwright.operators.audit import audit_entries
from maskwright.operators.gates import MIN_RESPONSE
from maskwright.operators.ordered import last_write_before, previous_value
from maskwright.operators.responses import DEBOUNCE_MS, echo_warning, pii_warnings, scan_responses
from maskwright.operators.vault import candidate_rows
from maskwright.plans.sanitize import sanitize
from maskwright.policy import Policy
from maskwright.session import cut_lineage, drop_staged, staged
from maskwright.sources.tables import prompts_of, read_responses
from maskwright.streaming.state import MERGE, State, bucket_of

#: How long a period of changes waits for late ones, where a job needs a watermark at all.
LATENESS = "10 minutes"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Place of a close behind everything else of its turn.
LAST = 2**31 - 1

#: What is read again: every table also has the number of the batch that wrote a row.
STATE = {
    "vault": "conv_id long, turn long, seq int, type string, token string, value string",
    "asked": "conv_id long, turn long, token string, ts timestamp",
    "closed": "conv_id long, turn long, ts timestamp",
    "seen": "conv_id long, turn long, ts timestamp",
    "ended": "conv_id long",
}
HELD = "conv_id long, turn long, token string, value string, late boolean"
LATE = "conv_id long, turn long, role string"
TOO_LATE = "conv_id long, turn long, role string, text string, domain string, ts timestamp"
WARNINGS = "conv_id long, turn long, type string, value string, reason string"
LAST_TEXT = "conv_id long, turn long, digest string"
SCANNED = "conv_id long, ts timestamp, warnings array<struct<type:string,value:string,reason:string>>, token_echo boolean, echo_detected boolean"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 256, lateness: str | None = None) -> DataFrame:
    """Parquet files as they arrive, a bounded number per micro-batch.

    Without ``lateness`` there is no watermark, and no row is ever dropped: the jobs on tables need none.  With it, steps
    that keep state in an operator (``debounce_stream``) drop what comes later than that.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows if lateness is None else rows.withWatermark("ts", lateness)


def run_available(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> None:
    """Process everything that is there, append it to parquet files and stop."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sanitize_stream(turns: DataFrame, **options) -> DataFrame:
    """Every prompt through the batch pipeline: one narrow projection, no state; tokens are numbered per text."""
    return sanitize(prompts_of(turns), **options)


@dataclass(frozen=True)
class Tables:
    """Tables below a folder that no batch reads, by name; one micro-batch adds one folder to each."""

    root: str

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """Rows of all batches, with the number of the batch."""
        try:
            return spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        return spark.createDataFrame([], f"{schema}, batch long")


def run_batches(df: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give every micro-batch that is there to ``put``."""
    return (
        df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    )


def micros(span: str | None) -> int | None:
    """Microseconds of a span like ``10 minutes``."""
    return None if span is None else SparkSession.active().sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {span}) AS n").first().n


def conversation_stream(
    turns: DataFrame, root: str, checkpoint: str, timeout: str | None = None, lateness: str | None = None, merge: int = MERGE, **options
) -> StreamingQuery:
    """Sanitize prompts with numbers per conversation, keep the vault, and look up the tokens of answers.

    Rows with role ``close`` end a conversation: answers of later turns find none of its tokens.  The clock is the latest
    ``ts`` of all earlier batches.  A conversation whose last row is older than ``timeout`` has ended too: it loses its
    tokens, and what comes after is a new conversation that is numbered from 1.  Rows older than ``lateness`` are
    not processed but listed as too late; what a close ended is then forgotten as well.  Without these two nothing
    but a close ends a conversation and no row is too late.  Rows without ``ts`` are never too late and keep no conversation
    from ending.  What has ended is not seen by any later batch, and every ``merge`` batches its rows are removed from the
    files: a batch reads what is alive, however long the stream has run.

    Tables below ``root``:

    ``sanitized``  prompts with their result; ``vault``  their tokens (read it by ``stream_vault``);
    ``held``       tokens of answers with the value they had, by turn.  An answer that came before the prompt it quotes
                   is looked up again when that prompt arrives: its row is then ``late`` (the last row counts);
    ``late``       rows behind a turn of their conversation that was processed before; ``too_late``  rows not processed;
    ``warnings``   tokens that answers repeat, and personal data in them.
    """
    if options.get("policy", Policy()).synthetic_mode:
        raise ValueError("fake values do not tell the number they were made from; streams of conversations use tokens")
    tables, idle, behind = Tables(root), micros(timeout), micros(lateness)
    if idle is not None and behind is not None and idle < behind:
        raise ValueError("a conversation must not time out before its rows are too late")

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = State.before(spark, root, batch_id)
        # Read for each of the tables; the source is read once.
        # Its files may be fewer than the cores, and all that follows is done in as many tasks.
        everything = rows = cut_lineage(batch.repartition("conv_id", "turn", "role"))
        if behind is not None and state.clock is not None:
            too_late = F.coalesce(F.unix_micros("ts") < state.clock - behind, F.lit(False))
            tables.write("too_late", rows.where(too_late).select("conv_id", "turn", "role", "text", "domain", "ts"), batch_id)
            rows = rows.where(~too_late)
        buckets = [r.b for r in rows.select(bucket_of(F.col("conv_id")).alias("b")).distinct().collect()]
        clock = everything.agg(F.max(F.unix_micros("ts")).alias("ts")).first().ts
        if not buckets:
            state.commit({}, {}, clock, merge)
            return
        convs = rows.select("conv_id").distinct()
        alive = _alive(state, idle, behind, convs, buckets)
        vault = alive("vault")
        known = vault.select("conv_id", "type", "value", F.regexp_extract("token", r"_([0-9]+)\]$", 1).cast("long").alias("n")).distinct()
        done = cut_lineage(sanitize(prompts_of(rows), known=known, numbering="conversation", **options))
        tables.write("sanitized", done.drop("detections", "semantic_hits"), batch_id)
        added = done.select("conv_id", "turn", F.explode("tokens").alias("t")).select("conv_id", "turn", "t.seq", "t.type", "t.token", "t.value")

        answers = read_responses(rows)
        asked = cut_lineage(candidate_rows(answers, None))
        closed = rows.where(F.col("role") == "close").select("conv_id", "turn", "ts")
        latest = alive("seen").groupBy("conv_id").agg(F.max("turn").alias("_last"))
        tables.write("late", rows.join(latest, "conv_id").where(F.col("turn") < F.col("_last")).select("conv_id", "turn", "role"), batch_id)

        # Answers of this batch, and earlier ones that quote a token of a prompt that came only now.
        again = alive("asked").select("conv_id", "turn", "token").join(
            added.select("conv_id", "token", F.col("turn").alias("_written")), ["conv_id", "token"]
        ).where(F.col("_written") < F.col("turn")).select("conv_id", "turn", "token").distinct()
        reads = cut_lineage(asked.withColumn("late", F.lit(False)).unionByName(again.withColumn("late", F.lit(True))))
        writes = vault.select("conv_id", "turn", "seq", "token", "value").unionByName(added.drop("type"))
        ends = alive("closed").select("conv_id", "turn").unionByName(closed.select("conv_id", "turn"))
        ended = writes.join(ends.withColumnRenamed("turn", "_end"), "conv_id").where(F.col("turn") <= F.col("_end")).select(
            "conv_id", F.col("_end").alias("turn"), F.lit(LAST).alias("seq"), "token", F.lit(None).cast("string").alias("value")
        ).distinct()
        found = last_write_before(reads.select("conv_id", "turn", "token"), writes.unionByName(ended), ["conv_id", "token"], "turn", "value", tie="seq")
        held = cut_lineage(found.where(F.col("value").isNotNull()).join(reads, ["conv_id", "turn", "token"]).select("conv_id", "turn", "token", "value", "late"))
        tables.write("held", held, batch_id)
        echoes = held.select("conv_id", "turn", echo_warning(F.col("token")).alias("w"))
        own = answers.select("conv_id", "turn", F.explode_outer(pii_warnings(F.col("text"))).alias("w")).where(F.col("w").isNotNull())
        tables.write("warnings", echoes.unionByName(own).select("conv_id", "turn", "w.type", "w.value", "w.reason"), batch_id)

        asked_at = asked.join(answers.groupBy("conv_id", "turn").agg(F.max("ts").alias("ts")), ["conv_id", "turn"])
        new = {
            "vault": added, "asked": asked_at, "closed": closed,
            "seen": rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max("ts").alias("ts")),
        }
        if idle is not None:
            new["ended"] = _expired(state, idle, convs, buckets)
        state.commit(new, STATE, clock, merge, _alive(state, idle, behind))

    return run_batches(turns, checkpoint, put)


def _expired(state: State, idle: int | None, convs: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Conversations (of ``convs``) whose last row is older than the timeout when a batch begins."""
    seen = _of(state.read("seen", STATE["seen"], buckets), convs)
    if idle is None or state.clock is None:
        return seen.select("conv_id").limit(0)
    last = seen.groupBy("conv_id").agg(F.max(F.unix_micros("ts")).alias("_ts"))
    return last.where(F.col("_ts") < state.clock - idle).select("conv_id")


def _of(rows: DataFrame, convs: DataFrame | None) -> DataFrame:
    return rows if convs is None else rows.join(convs, "conv_id", "left_semi")


def _alive(
    state: State, idle: int | None, behind: int | None, convs: DataFrame | None = None, buckets: list[int] | None = None
) -> Callable[[str], DataFrame]:
    """Reads of a table's rows (of ``convs``) that are not of conversations that have timed out or were closed long ago.

    Rows that were written before the batch in which a conversation began anew count as timed out; so a conversation
    ends alike whether its rows have been removed from the files or not.
    """

    def read(name: str) -> DataFrame:
        return _of(state.read(name, STATE[name], buckets), convs)

    def rows(name: str) -> DataFrame:
        found = read(name)
        if idle is not None:
            gone = _expired(state, idle, convs, buckets).select("conv_id", F.lit(state.batch_id).cast("long").alias("batch"))
            since = gone.unionByName(read("ended").select("conv_id", "batch")).groupBy("conv_id").agg(F.max("batch").alias("_since"))
            found = found.join(since, "conv_id", "left").where(F.col("_since").isNull() | (F.col("batch") >= F.col("_since"))).drop("_since")
        if behind is not None and state.clock is not None:
            old = F.unix_micros("ts") < state.clock - behind
            if name == "asked":  # no prompt that they quote can come any more
                found = found.where(~F.coalesce(old, F.lit(False)))
            if name in ("vault", "asked", "closed"):
                ends = read("closed").where(old).groupBy("conv_id").agg(F.max("turn").alias("_end"))
                found = found.join(ends, "conv_id", "left").where(F.col("_end").isNull() | (F.col("turn") > F.col("_end"))).drop("_end")
        if name == "seen":
            found = found.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max("ts").alias("ts"), F.max("batch").alias("batch"))
        return found.limit(0) if name == "ended" and convs is None else found

    return rows


def held_tokens(spark: SparkSession, root: str) -> DataFrame:
    """The tokens of answers with their values, as last looked up."""
    rows = Tables(root).read(spark, "held", HELD)
    return rows.groupBy("conv_id", "turn", "token").agg(F.max_by("value", "batch").alias("value"))


def stream_vault(spark: SparkSession, root: str) -> DataFrame:
    """The token vault that the stream wrote, as the batch jobs take it."""
    return State.latest(spark, root).read("vault", STATE["vault"]).select("conv_id", "turn", "seq", "token", "value")


def _gated(state: State, rows: DataFrame, buckets: list[int]) -> tuple[DataFrame, DataFrame]:
    """Those answers (``text`` trimmed and long enough, with its ``digest``) that differ from the one before in their
    conversation, and the last answer of each.

    An answer is compared with those of its batch, the first one with the last of earlier batches, if that is older.
    """
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    last = _last_texts(_of(state.read("last", LAST_TEXT, buckets), first))
    before = last.join(first, "conv_id").where(F.col("turn") < F.col("_first")).select("conv_id", "turn", "digest")
    order = rows.select("conv_id", "turn", "digest").unionByName(before)
    compared = previous_value(order, ["conv_id"], "turn", "digest", "_before", _ANSWER_RANGE).select("conv_id", "turn", "_before")
    kept = rows.join(compared, ["conv_id", "turn"]).where(F.col("_before").isNull() | (F.col("_before") != F.col("digest")))
    newest = rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("digest", "turn").alias("digest"))
    return kept.drop("digest", "_before"), newest


#: Answers are numbered or ordered by microseconds: an hour of these, or all numbers of one conversation of a batch.
_ANSWER_RANGE = 3_600_000_000


def _last_texts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("digest", "turn").alias("digest"), F.max("batch").alias("batch"))


def _worth(rows: DataFrame) -> DataFrame:
    """Answers that are long enough, trimmed, with a digest."""
    rows = rows.withColumn("text", strip(F.col("text"))).where(at_least(F.col("text"), MIN_RESPONSE))
    return rows.withColumn("digest", F.sha2("text", 256))


def _keep_last(state: State) -> Callable[[str], DataFrame]:
    return lambda name: _last_texts(state.read(name, LAST_TEXT))


def changed_answers(responses: DataFrame, root: str, checkpoint: str, merge: int = MERGE) -> StreamingQuery:
    """Write to ``changed`` the answers that are long enough and differ from the one before in their conversation.

    Of earlier batches a digest of each conversation's last answer is kept, one row for each.  Compares answers in order
    of turns within a batch and with the last one of earlier batches; one that comes behind a later turn is compared
    within its batch only.
    """
    tables = Tables(root)

    def put(batch: DataFrame, batch_id: int) -> None:
        state = State.before(batch.sparkSession, root, batch_id)
        rows = cut_lineage(_worth(batch))
        buckets = [r.b for r in rows.select(bucket_of(F.col("conv_id")).alias("b")).distinct().collect()]
        if buckets:
            kept, newest = _gated(state, rows, buckets)
            tables.write("changed", kept, batch_id)
            state.commit({"last": newest}, {"last": LAST_TEXT}, None, merge, _keep_last(state))

    return run_batches(responses, checkpoint, put)


def answer_stream(
    updates: DataFrame, vault: Callable[[], DataFrame], root: str, checkpoint: str, gap_ms: int = DEBOUNCE_MS, merge: int = MERGE
) -> StreamingQuery:
    """The whole way of live answers in one query: changes, quiet periods, the gate, the scan.

    ``updates`` (``conv_id, ts, text``, one row per change) has a watermark on ``ts``; the session windows of
    ``debounce_stream`` give the text of every quiet period once the watermark has passed it, in order of time for each
    conversation.  What differs from the last text scanned in its conversation (kept as in ``changed_answers``) is scanned for
    the tokens of ``vault()`` (``conv_id, ts, seq, token`` with the time of the prompt; read for every batch) and for
    personal data.  ``scanned`` below ``root`` gets the rows of ``operators.responses.scan_updates``.
    """
    tables = Tables(root)

    def put(batch: DataFrame, batch_id: int) -> None:
        state = State.before(batch.sparkSession, root, batch_id)
        quiet = batch.select("conv_id", F.unix_micros("ts").alias("turn"), "text")
        # Periods come from the state, but Spark sizes the batch by the files that came with it, maybe one row, and would
        # broadcast all texts that a late watermark lets go at once.  Stored, they have a size of their own.
        rows = staged(_worth(quiet), "quiet")
        buckets = [r.b for r in rows.select(bucket_of(F.col("conv_id")).alias("b")).distinct().collect()]
        if buckets:
            kept, newest = _gated(state, rows, buckets)
            written = vault().withColumn("turn", F.unix_micros(F.col("ts").cast("timestamp")))
            scanned = scan_responses(cut_lineage(kept), written.join(rows.select("conv_id").distinct(), "conv_id", "left_semi"))
            tables.write("scanned", scanned.withColumn("ts", F.timestamp_micros("turn")).drop("turn"), batch_id)
            state.commit({"last": newest}, {"last": LAST_TEXT}, None, merge, _keep_last(state))
        drop_staged(rows)

    return run_batches(debounce_stream(updates, gap_ms), checkpoint, put)


def debounce_stream(updates: DataFrame, gap_ms: int = DEBOUNCE_MS, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """The text visible once an answer has not changed for ``gap_ms``: one row per quiet period.

    A period is kept for each of ``keys``; with the turn among them a busy conversation is spread over its answers.

    ``updates`` has a watermark on ``ts``; a period is final once it has passed.
    Session windows also merge rows exactly one gap apart, which here are the
    end of a period, so the gap is a microsecond shorter.
    """
    return (
        updates.groupBy(*keys, F.session_window("ts", f"{gap_ms * 1000 - 1} microseconds").alias("w"))
        .agg(F.max(F.struct("ts", "text")).alias("last"))
        .select(*keys, "last.ts", "last.text")
    )


def running_stats(sanitized: DataFrame) -> DataFrame:
    """Counters that grow with every scanned prompt; write in update or complete mode."""
    return (
        sanitized.where(F.col("scanned"))
        .groupBy()
        .agg(F.count("*").alias("prompts_processed"), F.coalesce(F.sum("pii_count"), F.lit(0)).alias("pii_caught"))
    )


def write_counters(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every state of the counters to its own folder, which a retried batch overwrites."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stats.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(put)
        .start()
    )


def latest_counters(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("basePath", path)
        .parquet(path)
        .agg(F.max_by(F.struct("prompts_processed", "pii_caught"), "batch").alias("s"))
        .select("s.*")
    )


def audit_stream(sanitized: DataFrame) -> DataFrame:
    """Log entries as prompts arrive; old days are removed by the scheduled batch job."""
    return audit_entries(sanitized, ["conv_id", "turn"])
