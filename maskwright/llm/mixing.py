"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import fresh, hash_bits, unit_hash
from maskwright.session import staged

#: Sources of which rates are broadcast (a few hundred bytes each); beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0,
    source_col: str = "source",
) -> DataFrame:
    """``source, n, rate``: documents of each source and how often one of them is to appear on average.

    With ``weights`` a source gets that share (scaled to sum to 1 over the sources
    present; a source not named gets none), else a share in proportion to its
    number of documents to the power ``temperature``.  The rates are such that
    ``epochs`` times the number of documents are drawn on average.  A null source
    is a source of its own, named None in ``weights``.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    shares = staged(counts.withColumn("share", share), "sources")
    total = shares.agg(F.sum("n").alias("n"), F.sum("share").alias("share")).select(
        F.when(F.col("share") > 0, F.lit(float(epochs)) * F.col("n") / F.col("share")).otherwise(0.0)
    )
    return shares.select("source", "n", (F.col("share") * total.scalar() / F.col("n")).alias("rate"))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... for a Poisson distribution, as far as doubles tell them from 1.

    Summed in logarithms, so that large means do not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums"))
    summed = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda s, k: F.struct(
            (s["log"] + F.log(rate / k)).alias("log"),
            F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + F.exp(s["log"] + F.log(rate / k)))).alias("sums"),
        ),
    )["sums"]
    return F.when(rate > 0, summed).otherwise(F.array(F.lit(1.0)))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shuffled: bool = True,
    added: Sequence[str] = ("n_copies", "copy", "order_key"),
) -> DataFrame:
    """The rows of ``docs``, each repeated as often as its source needs, in a random global order.

    Adds ``n_copies``, ``copy`` (from 0) and ``order_key``, under the names ``added`` (columns of ``docs`` with these names are
    replaced: give others to keep them).  The number of
    copies is the Poisson quantile, with the source's rate as mean, of a hash of seed and id: retried tasks agree,
    no row depends on another, and a hot source needs nothing special.  The order is that of ``order_key``, a hash of
    seed, id and copy: partition by partition, each with an equal range of keys, sorted.  Rows without id draw by the MD5 of their text; repeated rows draw alike.
    An empty table gives an empty result.
    """
    rates = staged(
        source_rates(docs, weights, temperature, epochs, source_col).select("source", poisson_table(F.col("rate")).alias("sums")), "rates"
    )
    clean, (number, copy, key) = docs.drop(*added), added
    of, sums = fresh([*clean.columns, *added], "_of", "_sums")
    rates = rates.select(F.col("source").alias(of), F.col("sums").alias(sums))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    who = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    u = unit_hash(str(seed), F.lit("n"), who)
    drawn = clean.join(rates, F.col(source_col).eqNullSafe(F.col(of))).withColumn(
        number, F.size(F.filter(sums, lambda c: c <= u)).cast("long")
    )
    # Rows of no copies go behind the generator: where the source is a constant, Spark moves a filter before it to the wrong
    # side of the join.
    every = F.when(F.col(number) > 0, F.sequence(F.lit(0).cast("long"), F.col(number) - 1))
    copies = drawn.withColumn(copy, F.explode_outer(every)).where(F.col(copy).isNotNull())
    out = copies.withColumn(key, hash_bits(str(seed), F.lit("o"), who, F.col(copy))).drop(of, sums)
    if not shuffled:
        return out
    # Keys are even over 52 bits: their ranges are known, and no row is worked out twice to find them.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.shiftright(F.shiftright(key, 20) * F.lit(n).cast("long"), 32).cast("int")
    return out.repartitionById(n, place).sortWithinPartitions(key, id_col, copy)
