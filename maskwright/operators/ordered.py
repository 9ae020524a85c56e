"""Looking back within a group that may hold a large share of all rows.

A window over one conversation sorts the conversation in one task.  Here the
order column is cut into ranges: a window never spans more than one range of
one group, and what a range needs to know about the ranges before it is first
reduced to one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = 4096


def _range_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, width: int = RANGE
) -> DataFrame:
    """Add the value of the row before, by ``order`` within ``keys`` (null for the first)."""
    ranged = df.withColumn("_range", _range_of(order, width))
    last = ranged.groupBy(*keys, "_range").agg(F.max_by(value, order).alias("_last"))
    carried = last.select(
        *keys,
        "_range",
        F.lag("_last").over(W.partitionBy(*keys).orderBy("_range")).alias("_carried"),
    )
    within = W.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.withColumns({"_prev": F.lag(value).over(within), "_n": F.row_number().over(within)})
        .join(carried, [*keys, "_range"], "left")
        .withColumn(out, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev")))
        .drop("_range", "_prev", "_n", "_carried")
    )


def last_write_before(
    reads: DataFrame,
    writes: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    tie: str | None = None,
    width: int = RANGE,
) -> DataFrame:
    """As-of join: add to every read the latest written value with a smaller ``order``.

    ``tie`` orders writes of equal ``order``.  Reads without a write get null.
    """
    second = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    written = writes.select(
        *keys,
        F.col(order).alias("_o"),
        F.lit(1).alias("_w"),
        second.alias("_t"),
        F.struct(F.col(value).alias("v")).alias("_v"),
    ).withColumn("_range", _range_of("_o", width))
    asked = reads.select(
        *keys,
        F.col(order).alias("_o"),
        F.lit(0).alias("_w"),
        F.lit(0).cast("long").alias("_t"),
        F.lit(None).cast(written.schema["_v"].dataType).alias("_v"),
    ).withColumn("_range", _range_of("_o", width))

    # Ranges that are read but not written also need a carried value.
    ends = (
        written.groupBy(*keys, "_range")
        .agg(F.max_by("_v", F.struct("_o", "_t")).alias("_end"))
        .unionByName(
            asked.select(*keys, "_range").distinct().withColumn("_end", F.lit(None).cast(written.schema["_v"].dataType))
        )
        .groupBy(*keys, "_range")
        .agg(F.first("_end", ignorenulls=True).alias("_end"))
    )
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")
    )
    # Reads sort in front of writes of the same order, so they do not see them.
    so_far = (
        W.partitionBy(*keys, "_range")
        .orderBy("_o", "_w", "_t")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        written.unionByName(asked)
        .withColumn("_seen", F.last("_v", ignorenulls=True).over(so_far))
        .where(F.col("_w") == 0)
        .join(carried, [*keys, "_range"], "left")
        .select(
            *keys,
            F.col("_o").alias(order),
            F.coalesce(F.col("_seen"), F.col("_carried"))["v"].alias(value),
        )
    )


def running_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, width: int = RANGE
) -> DataFrame:
    """Number the rows of every group from 1 in ``order``; the first order column is ranged."""
    ranged = df.withColumn("_range", _range_of(order[0], width))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = W.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn("_k", F.row_number().over(within))
        .join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_offset") + F.col("_k"))
        .drop("_range", "_k", "_offset")
    )


def next_within(df: DataFrame, keys: Sequence[str], order: str, gap: int, out: str, width: int) -> DataFrame:
    """Add ``out``: another row of the group follows less than ``gap`` later.

    Of rows at the same place only the last, by the columns of the row, has no
    follower.  As a range is longer than the gap, a follower lies in the same
    range or at the start of the next one.
    """
    if width < gap:
        raise ValueError("a range must be at least as long as the gap")
    ranged = df.withColumn("_range", _range_of(order, width))
    starts = ranged.groupBy(*keys, (F.col("_range") - 1).alias("_range")).agg(
        F.min(order).alias("_next_range")
    )
    others = [c for c in df.columns if c not in (*keys, order)]
    within = W.partitionBy(*keys, "_range").orderBy(order, *others)
    follower = F.coalesce(F.col("_next"), F.col("_next_range"))
    return (
        ranged.withColumn("_next", F.lead(order).over(within))
        .join(starts, [*keys, "_range"], "left")
        .withColumn(out, F.coalesce(follower - F.col(order) < gap, F.lit(False)))
        .drop("_range", "_next", "_next_range")
    )
