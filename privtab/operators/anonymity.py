"""k-anonymity by suppression.

Everything is derived from one class-size table, ``groupBy(by + qis)``.
That aggregate combines map-side, so a hot equivalence class (even a third
of all rows) never reaches one task as rows; it arrives as partial counts.
Sweeps over many k (and many seeds, via ``by``) reuse the same table: the k
list is a generator (``explode``) over class sizes, not a rescan per k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privtab.functions.exprs import round_half_up_ratio
from privtab.session import small_table

NO_ROWS = "No training rows left after K-anonymity"
ONE_CLASS = "Only one class left after K-anonymity"

_POLICIES = ("suppress", "group")


def _null_flag(qis: Sequence[str], null_policy: str) -> Column:
    if null_policy not in _POLICIES:
        raise ValueError(f"null_policy must be one of {_POLICIES}")
    if null_policy == "group":
        return F.lit(False)
    flag = F.lit(False)
    for q in qis:
        flag = flag | F.col(q).isNull()
    return flag


def quasi_identifiers(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """K7: the wanted quasi-identifiers the table has; error when none."""
    qis = [q for q in wanted if q in df.columns]
    if not qis:
        raise ValueError(f"no quasi-identifier available; wanted {list(wanted)}")
    return qis


def model_features(features: Sequence[str], bands: dict[str, str]) -> list[str]:
    """Replace each precise feature by its band column (when banded),
    de-duplicated in order."""
    out: list[str] = []
    for f in features:
        g = bands.get(f, f)
        if g not in out:
            out.append(g)
    return out


def class_sizes(df: DataFrame, qis: Sequence[str], by: Sequence[str] = (),
                null_policy: str = "suppress", target: str | None = None) -> DataFrame:
    """K1: rows per equivalence class.

    Columns: ``by``, ``qis``, ``n`` (bigint), ``unclassed`` (True for a group
    holding a NULL quasi-identifier under the ``suppress`` policy: such rows
    belong to no class and are always suppressed), and ``n_pos`` (rows with
    ``target = 1``) when ``target`` is given.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    if target is not None:
        aggs.append(F.count_if(F.col(target) == 1).alias("n_pos"))
    sizes = df.groupBy(*by, *qis).agg(*aggs)
    return sizes.withColumn("unclassed", _null_flag(qis, null_policy))


def with_class_size(df: DataFrame, qis: Sequence[str], by: Sequence[str] = (),
                    null_policy: str = "suppress", out: str = "class_size") -> DataFrame:
    """The size of its equivalence class on every row (NULL for unclassed
    rows).  Aggregate-then-join: the size table is stored and broadcast only if
    small, so rows are not shuffled by class; AQE splits a hot class otherwise."""
    sizes = class_sizes(df, qis, by, null_policy)
    keys = list(by) + list(qis)
    s = small_table(sizes.where(~F.col("unclassed")).select(*keys, F.col("n").alias(out)), "class-sizes")
    if null_policy == "suppress":
        return df.join(s, keys, "left")
    left, right = df.alias("_l"), s.alias("_r")
    cond = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    return left.join(right, cond, "left").select("_l.*", F.col(f"_r.{out}"))


def k_suppress(df: DataFrame, qis: Sequence[str], k: int, by: Sequence[str] = (),
               null_policy: str = "suppress") -> DataFrame:
    """Keep rows whose equivalence class has at least ``k`` rows."""
    keys = list(by) + list(qis)
    keep = (class_sizes(df, qis, by, null_policy)
            .where(~F.col("unclassed") & (F.col("n") >= F.lit(k))).select(*keys))
    if null_policy == "suppress":
        return df.join(keep, keys, "left_semi")
    cond = [F.col(f"_l.{k_}").eqNullSafe(F.col(f"_r.{k_}")) for k_ in keys]
    return df.alias("_l").join(keep.alias("_r"), cond, "left_semi")


def sweep_sizes(sizes: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """K3/K4/K8 from a class-size table: one row per (by, k).

    ``train_rows_used``, ``rows_suppressed``, ``suppression_rate`` (percent,
    2 places, half-up, 0 for an empty input), ``classes_before``,
    ``classes_after``, ``min_class_size`` (0 when nothing is left); plus
    ``pos_kept`` when the size table carries ``n_pos``.
    """
    has_pos = "n_pos" in sizes.columns
    x = sizes.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    # k = 1 is the baseline: it suppresses nothing, unclassed rows included
    kept = (F.col("k") <= 1) | ~F.col("unclassed") & (F.col("n") >= F.col("k"))
    aggs = [
        F.sum("n").alias("_total"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("train_rows_used"),
        F.count_if(~F.col("unclassed")).alias("classes_before"),
        F.count_if(kept & ~F.col("unclassed")).alias("classes_after"),
        F.coalesce(F.min(F.when(kept, F.col("n"))), F.lit(0)).alias("min_class_size"),
    ]
    if has_pos:
        aggs.append(F.coalesce(F.sum(F.when(kept, F.col("n_pos"))), F.lit(0)).alias("pos_kept"))
    g = x.groupBy(*by, "k").agg(*aggs)
    g = (g.withColumn("train_rows_used", F.col("train_rows_used").cast("bigint"))
          .withColumn("rows_suppressed", (F.col("_total") - F.col("train_rows_used")).cast("bigint"))
          .withColumn("suppression_rate",
                      round_half_up_ratio(F.col("rows_suppressed"), F.col("_total"), 2, 100))
          .withColumn("min_class_size", F.col("min_class_size").cast("bigint")))
    cols = [*by, "k", "train_rows_used", "rows_suppressed", "suppression_rate",
            "classes_before", "classes_after", "min_class_size"]
    if has_pos:
        cols.append(F.col("pos_kept").cast("bigint").alias("pos_kept"))
    return g.select(*cols)


def k_sweep(df: DataFrame, qis: Sequence[str], ks: Sequence[int], by: Sequence[str] = (),
            null_policy: str = "suppress", target: str | None = None) -> DataFrame:
    """K4: statistics for every k in one scan (and every ``by`` group, e.g.
    seed, in the same job)."""
    return sweep_sizes(class_sizes(df, qis, by, null_policy, target), ks, by)


def k_stats(df: DataFrame, qis: Sequence[str], k: int, by: Sequence[str] = (),
            null_policy: str = "suppress") -> DataFrame:
    """K3 (K8 with ``k=1``): statistics of one k."""
    return k_sweep(df, qis, [k], by, null_policy)


def skip_reason(stats: DataFrame) -> DataFrame:
    """K9: why a (seed, k) run cannot train, from kept row and positive counts.

    Needs ``train_rows_used`` and ``pos_kept``; adds ``skipped_reason`` ('' when
    the run can train)."""
    used, pos = F.col("train_rows_used"), F.col("pos_kept")
    return stats.withColumn(
        "skipped_reason",
        F.when(used == 0, F.lit(NO_ROWS))
         .when((pos == 0) | (pos == used), F.lit(ONE_CLASS))
         .otherwise(F.lit("")))
