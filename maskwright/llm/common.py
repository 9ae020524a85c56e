"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import prepare

#: Rows of one Arrow batch: with texts of some kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 512


def setup(spark: SparkSession) -> SparkSession:
    """Settings of the jobs of this package: those of the library, and short Arrow batches for long texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setup(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``taken``."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 random bits, decided by the parts (joined by colons; null counts as empty)."""
    return hash_bits(*parts).cast("double") / F.lit(float(1 << 52))


def hash_bits(*parts: Column | str) -> Column:
    """52 bits of the MD5 of the parts, as a long."""
    joined = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("long")
