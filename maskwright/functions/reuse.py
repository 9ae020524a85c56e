"""Keeping built columns.

A detector or a rewriting step is an expression of a few thousand nodes, and
each node is a call from Python into the JVM.  Columns are independent of the
frame they are used on, so one that was built for a session is built once.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession

_LIMIT = 256
_BUILT: WeakKeyDictionary[SparkSession, dict[Hashable, Column]] = WeakKeyDictionary()


def built_once(df: DataFrame, build: Callable[..., Column], *args: Hashable) -> Column:
    """``build(*args)``, kept for the session of ``df``."""
    columns = _BUILT.setdefault(df.sparkSession, {})
    key = (build, args)
    if key not in columns:
        if len(columns) >= _LIMIT:
            columns.clear()
        columns[key] = build(*args)
    return columns[key]
