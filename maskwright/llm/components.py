"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import drop_staged, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: every linked node with the smallest node it can reach, itself included.

    Alternating large and small stars: each round hangs the larger neighbours of
    a node, then the smaller ones, under the least of them, which needs a number
    of rounds that is logarithmic in the graph's size.  A round is two minima by
    node (summed up before the shuffle) and two equi-joins; a node with very many
    links is split by the skew join.  Every round is written to the shared folder, then the one before it is removed.
    Null ends and loops are left out; without links the result is empty.
    """
    raw = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = staged(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _digest(edges)
    while before[0]:
        older, edges = edges, staged(_small_star(_large_star(edges)), "links")
        after = _digest(edges)
        drop_staged(older)
        if after == before:
            break
        before = after
    # Stars are left: each node hangs under its root.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node goes under the node's least neighbour (or the node)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go under the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    under = edges.join(least, "u")
    return (
        under.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )
