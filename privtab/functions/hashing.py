"""Deterministic per-row randomness that every engine reproduces.

``md5("<seed>:<key>")`` gives the same hex text in Spark and in plain SQL
engines, so splits, samples and site assignments can be checked row by row.
These draws are for reproducible experiments; privacy noise and masks in
production must come from a secure source instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def hash_hex(seed, *keys) -> Column:
    """md5 hex of ``seed:key1:key2...``; ``seed`` is an int or a column."""
    seed_c = F.lit(str(seed)) if isinstance(seed, int) else _as_col(seed).cast("string")
    parts = [seed_c] + [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(hex_col: Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex digits (uniform bucket id)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def hash_unit(hex_col: Column) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits (52 bits)."""
    return hash_bucket(hex_col, 13).cast("double") / F.lit(float(16 ** 13))
