"""Reading turns and answers; writing and reading the vault and the audit log."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import strip
from maskwright.operators.audit import audit_json
from maskwright.operators.gates import non_blank
from maskwright.operators.vault import token_history
from maskwright.policy import Policy
from maskwright.session import spread


def read_table(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """A table for the scanning jobs: files that are fewer than the cores are dealt out by ``keys`` first.

    Results are the same either way; inputs of at least one full split per core are read as they are.
    """
    return spread(spark.read.parquet(path), *keys)


def read_turns(spark: SparkSession, path: str, schema: str | None = None, stream: bool = False) -> DataFrame:
    """Prompts: non-blank user turns, as a table or (``stream=True``) as a stream of files."""
    if stream:
        reader = spark.readStream
        schema = schema or spark.read.parquet(path).schema
        turns = reader.schema(schema).parquet(path)
    else:
        turns = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return prompts_of(turns)


def prompts_of(turns: DataFrame) -> DataFrame:
    return non_blank(turns.where(F.col("role") == "user"))


def read_responses(turns: DataFrame) -> DataFrame:
    """Answers, trimmed."""
    return turns.where(F.col("role") == "assistant").withColumn("text", strip(F.col("text")))


#: Folders of a vault; a conversation lies in one of them.
VAULT_BUCKETS = 64


def _bucket(conv: Column) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(VAULT_BUCKETS)).cast("int")


def _commit(rows: DataFrame, path: str, folder: str, commit: str | None) -> None:
    """Add rows below ``folder=.../commit=...``; what a commit of this name wrote before is replaced.

    Rows of a folder are brought together first (a large folder in several parts), as every task writes a file for each folder
    it has rows of.
    """
    named = rows.hint("rebalance", folder).withColumn("commit", F.lit(f"c-{commit or uuid.uuid4().hex}"))
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(folder, "commit").parquet(path)


def write_token_vault(vault: DataFrame, path: str, commit: str | None = None) -> None:
    """Append vault rows, in folders by a hash of the conversation.

    A job that is run again under the same ``commit`` replaces its rows instead of doubling them.
    """
    _commit(vault.withColumn("bucket", _bucket(F.col("conv_id"))), path, "bucket", commit)


def read_token_vault(spark: SparkSession, path: str, conv_ids: Iterable[int] | None = None) -> DataFrame:
    """Vault rows; with ``conv_ids`` of these conversations, and only their folders are read."""
    rows = spark.read.parquet(path).drop("commit")
    if conv_ids is None:
        return rows.drop("bucket")
    ids = sorted(set(conv_ids))
    asked = spark.createDataFrame([(i,) for i in ids], "conv_id long").select("conv_id", _bucket(F.col("conv_id")).alias("bucket"))
    buckets = sorted({r.bucket for r in asked.collect()})
    return rows.where(F.col("bucket").isin(*buckets)).join(asked.select("conv_id"), "conv_id", "left_semi").drop("bucket")


def write_vault_table(vault: DataFrame, name: str, path: str | None = None, buckets: int = VAULT_BUCKETS) -> DataFrame:
    """Store what every token has stood for as a table in buckets by conversation and token, sorted; returns the table.

    ``operators.vault.restore`` takes it for the vault and joins it without shuffling it.
    """
    writer = token_history(vault).write.mode("overwrite").bucketBy(buckets, "conv_id", "token").sortBy("conv_id", "token")
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return vault.sparkSession.table(name)


def append_audit(entries: DataFrame, path: str, commit: str | None = None) -> None:
    """Append log entries, one folder per day; ``commit`` as in ``write_token_vault``."""
    _commit(entries, path, "day", commit)


def append_and_purge(entries: DataFrame, path: str, policy: Policy, now_ms: int, commit: str | None = None) -> list[str]:
    """Append log entries and remove the days that are too old, as one step that can be repeated."""
    append_audit(entries, path, commit)
    return purge_audit(entries.sparkSession, path, policy, now_ms)


def purge_audit(spark: SparkSession, path: str, policy: Policy, now_ms: int) -> list[str]:
    """Remove the days of a log that end before the policy's retention begins; returns them.

    Whole day folders go, without reading their files.  What is left of the day the limit falls into is hidden by
    ``operators.audit.retained`` until it goes as well.
    """
    first = datetime.fromtimestamp(now_ms / 1000 - policy.audit_retention_days * 86400, timezone.utc).date().isoformat()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("day=")]
    old = [d for d in days if d.getName().removeprefix("day=") < first]
    for day in old:
        files.delete(day, True)
    return sorted(d.getName().removeprefix("day=") for d in old)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("commit")


def export_audit_json(audit: DataFrame, path: str) -> None:
    """Write the log as JSON lines."""
    audit_json(audit).select("json").write.mode("overwrite").text(path)
