"""Cases of the fourth round of findings."""

import pytest
from pyspark.sql import functions as F

from maskwright import session
from maskwright.llm import simhash
from maskwright.session import input_bytes, measured, staged, work_dir
from maskwright.streaming import flow


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prints(spark):
    """Fingerprints of which many are close to each other, stored as the job stores them."""
    return staged(spark.range(64).select((F.col("id") * 3).alias("fp")), "prints")


def test_rows_of_many_keys_are_not_broadcast(prints):
    links = simhash.fingerprint_links(prints)
    assert "BroadcastExchange" not in plan(links) and "SortMergeJoin" in plan(links)
    values = [r.fp for r in prints.collect()]
    found = {(r.a, r.b) for r in links.collect()}
    assert found == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= simhash.MAX_BITS}


def test_balls_are_broadcast_by_their_number(prints, monkeypatch):
    assert "BroadcastHashJoin" in plan(simhash._ball_links(prints, 3))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 64 * 65 - 1)
    links = simhash._ball_links(prints, 3)
    assert "BroadcastExchange" not in plan(links)
    assert all((r.a ^ r.b).bit_count() <= 6 for r in links.collect())


def test_stored_rows_are_broadcast_by_their_number(spark, monkeypatch):
    few, rows = staged(spark.range(10), "few"), staged(spark.range(1000), "rows")
    assert "BroadcastHashJoin" in plan(rows.join(measured(few), "id"))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 9)
    joined = rows.join(measured(few), "id")
    assert "BroadcastExchange" not in plan(joined) and joined.count() == 10


def test_texts_that_a_late_watermark_lets_go_have_their_own_size(spark, monkeypatch):
    schema, out = "conv_id long, ts timestamp, text string", work_dir(spark, "freed")
    noise = F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(k)).cast("binary"), 256) for k in range(20)])
    answers = spark.range(200).select(F.col("id").alias("conv_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), noise.alias("text"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"), F.lit("").alias("text"))
    for rows in (answers, end, end):  # a file, and a batch, each
        rows.coalesce(1).write.mode("append").parquet(f"{out}/updates")
    seen, gated = [], flow._gated

    def noted(state, rows, buckets):
        seen.append((rows.agg(F.sum(F.length("text"))).first()[0], input_bytes(rows)))
        return gated(state, rows, buckets)

    monkeypatch.setattr(flow, "_gated", noted)
    changed = flow.read_stream(spark, f"{out}/updates", schema, files_per_batch=1, lateness="10 seconds")
    vault = spark.createDataFrame([], "conv_id long, ts timestamp, seq int, token string")
    flow.answer_stream(changed, lambda: vault, f"{out}/tables", f"{out}/checkpoint").awaitTermination()
    assert flow.Tables(f"{out}/tables").read(spark, "scanned", flow.SCANNED).count() == 200
    # What comes from the state is larger than the files of its batch.
    assert sum(n for n, _ in seen) == 200 * (20 * 65 - 1) and all(size > n / 4 for n, size in seen), seen
