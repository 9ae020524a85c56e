"""Shards by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import unit_hash

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Ranges of a shard that are numbered apart from each other.
RANGES = 4096


def _draw(name: str, weight: float, key: Column) -> Column:
    """An exponential waiting time with rate ``weight``: the least of several wins in proportion to their weights,
    and a changed weight changes the draw of its own branch only."""
    return -F.log(F.lit(1.0) - unit_hash(name, key)) / F.lit(float(weight))


def _winner(names: Iterable[tuple[str, float, Column]], key: Column) -> Column:
    draws = [F.struct(_draw(path, w, key).alias("t"), then.alias("s")) for path, w, then in names if w > 0]
    if not draws:
        return F.lit(None).cast("int")
    return draws[0]["s"] if len(draws) == 1 else F.least(*draws)["s"]


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard (int) of a key: a weighted hash draw for the region, then for the rack in it, then for the shard.

    Only the names, the weights and the key decide.  If a weight changes, keys
    move only into or out of the branches that hold it; a branch added as a region
    of its own takes keys only into itself.  A null key is a key of its own.
    """

    def total(node: Mapping | float) -> float:
        return sum(map(total, node.values())) if isinstance(node, Mapping) else float(node)

    def level(node: Mapping, path: str) -> Column:
        below = []
        for name, child in node.items():
            here = f"{path}/{name}"
            then = level(child, here) if isinstance(child, Mapping) else F.lit(int(name))
            below.append((here, total(child), then))
        return chosen(below)

    def chosen(below: list[tuple[str, float, Column]]) -> Column:
        # The number of the winning branch first: what lies below the others is not evaluated.
        at = _winner([(path, w, F.lit(i)) for i, (path, w, _) in enumerate(below)], key)
        return reduce(lambda rest, it: F.when(at == it[0], it[1][2]).otherwise(rest), list(enumerate(below))[1:], below[0][2])

    return level(tree, "")


def shard_rows(
    docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the UTF-8 length plus 1 and ``text_crc32`` the CRC-32 of the text (a null text counts as empty).
    The law is ``key``: the id and the tree decide, so equal texts of different ids may part, and rows that share an
    id (or have none) stay together.  ``slot`` numbers the rows of a shard from 0 without gaps, in order of a hash of
    the id, the id, size and checksum.  Equal rows are counted before they are shuffled and take consecutive slots;
    a shard is numbered in ``ranges`` ranges of the hash, whose first slots come from their row counts
    (shards times ``ranges`` numbers, the only thing that is broadcast).
    """
    key = F.col(id_col)
    rows = (
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
        )
        .groupBy("id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
    )
    key = F.col("id")
    placed = rows.withColumns(
        {
            "shard": tree_shard(key, tree).cast("int"),
            "grown_shard": (tree_shard(key, grown) if grown is not None else F.lit(None)).cast("int"),
            "place": unit_hash("slot", key),
        }
    ).withColumn("range", F.floor(F.col("place") * ranges).cast("int"))
    counts = placed.groupBy("shard", "range").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "range", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("first"))
    inside = (
        Window.partitionBy("shard", "range").orderBy("place", "id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(first), ["shard", "range"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("before") + F.col("copy")).cast("long").alias("slot"), "grown_shard",
        )
    )
