"""Feature encoding (E1-E3, E6): label codes, min-max scaling, class weights.

Fitted constants enter the plan as literals (min/max: one aggregate job) or
as stored tables, broadcast if their size allows (per-group min/max, class
sizes); dictionaries are joined as the engine chooses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privtab.session import materialize, small_table

def label_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Dictionary of ``col``: each distinct non-null value (as text) and its
    0-based position in sorted order.

    The distinct values are dealt out by range and kept in the checkpoint
    folder with their partition; a position is the number of values in the
    partitions before plus the place inside the partition.  The only global
    window runs over one row per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()
    dealt = materialize(values.repartitionByRange(parts, col).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(col)) - 1
    return (dealt.withColumn("_place", place).join(offsets, "_part")
            .select(col, (F.col("_off") + F.col("_place")).cast("int").alias(out)))


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by its code (sorted distinct order, T3).

    Joined back by value; AQE broadcasts the dictionary when small."""
    for c in cols:
        codes = label_codes(df, c, "_code")
        df = (df.withColumn(c, F.col(c).cast("string"))
                .join(codes, c, "left").withColumn(c, F.col("_code")).drop("_code"))
    return df


def minmax_params(train: DataFrame, cols: Sequence[str]) -> dict:
    """Per-column (min, max) of ``train``: one aggregate job for all
    columns whose 2 x columns numbers come back as literals (as a fitted
    scaler's parameters; a scalar subquery would be re-run per reference)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    row = train.agg(*aggs).first()
    return {c: (F.lit(row[f"mn{i}"]).cast("double"), F.lit(row[f"mx{i}"]).cast("double"))
            for i, c in enumerate(cols)}


def minmax_apply(df: DataFrame, params: dict, suffix: str = "") -> DataFrame:
    """``(x - min) / (max - min)``; 0 for a constant column (T2).  No
    clipping: rows outside the fitted range leave [0, 1]."""
    for c, (mn, mx) in params.items():
        x = F.col(c).cast("double")
        scaled = F.coalesce(F.try_divide(x - mn, F.nullif(mx - mn, F.lit(0.0))), F.lit(0.0))
        df = df.withColumn(c + suffix, F.when(x.isNull(), None).otherwise(scaled))
    return df


def minmax_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                 suffix: str = "") -> DataFrame:
    """E2 (fit on all rows) or E3 (``fit_on`` = the training rows)."""
    return minmax_apply(df, minmax_params(fit_on if fit_on is not None else df, cols), suffix)


def minmax_by(df: DataFrame, cols: Sequence[str], by: Sequence[str],
              fit_on: DataFrame | None = None) -> DataFrame:
    """E3 per group: min-max fitted on ``fit_on`` (default ``df``) separately
    for each ``by`` group (e.g. every k of a sweep) and applied to ``df``.
    The fitted table has one row per group; it is stored, and broadcast only
    if small, so rows are not shuffled by group."""
    src = fit_on if fit_on is not None else df
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"_mn{i}"), F.max(x).alias(f"_mx{i}")]
    params = small_table(src.groupBy(*by).agg(*aggs), "minmax")
    out = df.join(params, list(by), "inner")
    for i, c in enumerate(cols):
        x, mn, mx = F.col(c).cast("double"), F.col(f"_mn{i}"), F.col(f"_mx{i}")
        out = out.withColumn(c, F.when(x.isNull(), None).otherwise(
            F.coalesce(F.try_divide(x - mn, F.nullif(mx - mn, F.lit(0.0))), F.lit(0.0))))
    return out.drop(*[f"_mn{i}" for i in range(len(cols))], *[f"_mx{i}" for i in range(len(cols))])


def balanced_weights(df: DataFrame, target: str, by: Sequence[str] = (),
                     out: str = "weight") -> DataFrame:
    """Class weight ``n / (n_classes * n_c)`` on every row.

    Class counts are a stored table of (groups x classes) rows, broadcast only
    if small, so rows are not shuffled by class."""
    by = list(by)
    counts = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("_nc"))
    g = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = (counts.withColumn("_n", F.sum("_nc").over(g))
                    .withColumn("_k", F.count(F.lit(1)).over(g))
                    .select(*by, target,
                            (F.col("_n").cast("double") / (F.col("_k") * F.col("_nc")).cast("double"))
                            .alias(out)))
    return df.join(small_table(counts, "class-weights"), [*by, target], "left")
