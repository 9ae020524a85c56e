"""Array building blocks used by the per-row jobs.

Everything here is a Column -> Column function.  The per-row jobs must stay
near-linear in the number of matches of one text, because a single text may be
a whole log file: no growing accumulators, no nested scans over all matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A column captured by a lambda is evaluated again for every element; binding
    it to a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


def _levels(xs: Column, fold: Callable[[Column], Column], body: Callable[[Callable[[Column], list[Column]]], Column]) -> Column:
    """Fold what stands in front of an element in three steps: whole blocks of 4096, whole blocks of 64, the rest.

    ``body`` gets a function from an index to these three folds; each reads at most 64 numbers as long as there are
    fewer than 64 * 4096 elements.
    """

    def blocks(values: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(values) / _BLOCK).cast("int")),
            lambda b: fold(F.slice(values, b * _BLOCK + 1, _BLOCK)),
        )

    def with_small(small: Column) -> Column:
        def with_large(large: Column) -> Column:
            def parts(i: Column) -> list[Column]:
                s, t = F.floor(i / _BLOCK).cast("int"), F.floor(i / _BLOCK**2).cast("int")
                return [
                    fold(F.slice(large, 1, t)),
                    fold(F.slice(small, t * _BLOCK + 1, s - t * _BLOCK)),
                    fold(F.slice(xs, s * _BLOCK + 1, i - s * _BLOCK)),
                ]

            return body(parts)

        return let(blocks(small), with_large)

    return let(blocks(xs), with_small)


def sums_before(numbers: Column) -> Column:
    """For every element the sum of all elements in front of it."""
    return let(
        numbers,
        lambda xs: _levels(
            xs, total, lambda parts: F.transform(xs, lambda _, i: parts(i)[0] + parts(i)[1] + parts(i)[2])
        ),
    )


def heads(xs: Column, differs: Callable[[Column, Column], Column]) -> Column:
    """Indexes at which a new run starts in an array already in run order."""
    return F.filter(
        F.sequence(F.lit(0), F.size(xs) - 1),
        lambda j: (j == 0) | differs(F.get(xs, j), F.get(xs, j - 1)),
    )


def first_per_key(xs: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element of every key, in the order of first appearance."""

    def pick(keyed: Column) -> Column:
        kept = F.filter(keyed, lambda x, j: (j == 0) | (x["k"] != F.get(keyed, j - 1)["k"]))
        return F.transform(
            F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))),
            lambda x: x["x"],
        )

    keyed = F.array_sort(
        F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    )
    return F.when(F.size(xs) < 2, xs).otherwise(let(keyed, pick))


def number_per_type(spans: Column) -> Column:
    """Running number (from 1) per ``type``; equal (type, value) pairs share one.

    ``spans`` must be in text order.  The result is aligned with it.
    """

    def numbered(order: Column) -> Column:
        # One entry per distinct (type, value): where its run starts, and where
        # in the text it was first seen.
        firsts = F.array_sort(
            F.transform(
                heads(order, lambda a, b: (a["type"] != b["type"]) | (a["value"] != b["value"])),
                lambda j: F.struct(
                    F.get(order, j)["type"].alias("type"), F.get(order, j)["i"].alias("i"), j.alias("j")
                ),
            )
        )

        def with_firsts(fs: Column) -> Column:
            type_starts = heads(fs, lambda a, b: a["type"] != b["type"])

            def ranked(starts: Column) -> Column:
                by_run = F.array_sort(
                    F.transform(
                        fs,
                        lambda f, p: F.struct(
                            f["j"].alias("j"),
                            (p + 1 - F.array_max(F.filter(starts, lambda s: s <= p))).alias("n"),
                        ),
                    )
                )
                return let(
                    by_run,
                    lambda runs: F.flatten(
                        F.transform(
                            runs,
                            lambda r, k: F.transform(
                                F.slice(
                                    order,
                                    r["j"] + 1,
                                    F.coalesce(F.get(runs, k + 1)["j"], F.size(order)) - r["j"],
                                ),
                                lambda o: F.struct(o["i"].alias("i"), r["n"].alias("n")),
                            ),
                        )
                    ),
                )

            return let(type_starts, ranked)

        return let(firsts, with_firsts)

    order = F.array_sort(
        F.transform(
            spans, lambda s, i: F.struct(s["type"].alias("type"), s["value"].alias("value"), i.alias("i"))
        )
    )
    numbers = F.transform(F.array_sort(let(order, numbered)), lambda x: x["n"])
    return F.when(F.size(spans) == 0, F.array().cast("array<int>")).otherwise(numbers)


def max_before(numbers: Column) -> Column:
    """For every element the largest element in front of it (0 for the first)."""

    def largest(xs: Column) -> Column:
        return F.coalesce(F.array_max(xs), F.lit(0))

    return let(
        numbers,
        lambda xs: _levels(xs, largest, lambda parts: F.transform(xs, lambda _, i: F.greatest(*parts(i)))),
    )
