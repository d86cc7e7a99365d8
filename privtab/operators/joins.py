"""Joins (J1): a chain of inner equi-joins on one key.

The strategy (broadcast hash vs sort-merge, and skew splitting) is left to
AQE, which decides from run-time sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def join_pair(left: DataFrame, right: DataFrame, on: Sequence[str],
              suffixes=("_x", "_y")) -> DataFrame:
    """Inner join on ``on``; other names present on both sides get suffixes."""
    on = list(on)
    overlap = (set(left.columns) & set(right.columns)) - set(on)
    for c in overlap:
        left = left.withColumnRenamed(c, c + suffixes[0])
        right = right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, on, "inner")


def join_all(tables: Sequence[DataFrame], on, suffixes=("_x", "_y")) -> DataFrame:
    """``tables[0] ⋈ tables[1] ⋈ ...`` on the same key column(s)."""
    keys = [on] if isinstance(on, str) else list(on)
    return reduce(lambda a, b: join_pair(a, b, keys, suffixes), tables)
