"""Registry of named queries: a Spark job and, where SQL can say it, the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.plans.seed import seeded_turns
from maskwright.sources.tables import read_table

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Job
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def register(name: str, run: Job, sql: str | None = None) -> None:
    if name in CATALOG:
        raise ValueError(f"query {name!r} is registered twice")
    CATALOG[name] = Query(run, sql)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", "doc_id").select("doc_id", *(columns or ("text",)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts: the documents and the seeded turns."""
    docs = documents(spark, sf_dir).select(
        F.lit("document").alias("src"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("sub"), "text"
    )
    turns = seeded_turns(spark, sf_dir).select(
        F.lit("turn").alias("src"), F.col("conv_id").alias("id"), F.col("turn").alias("sub"), "text"
    )
    return docs.unionByName(turns)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents, empty ones included."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


LINES_SQL = (
    "lines AS (SELECT doc_id, CAST(unnest(range(0, len(parts))) AS INTEGER) AS line, unnest(parts) AS text "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"
)
