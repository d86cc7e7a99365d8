"""Result tables.

Report inputs are run tables (one row per seed x model x setting); every
operator here is an aggregate or projection over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privtab.functions.exprs import mean_std_text, round_fixed, round_half_up_ratio
from privtab.functions.labels import epsilon_of, k_of, mean_of, std_of

# K order of the published k-anonymity reports.
K_ORDER = [2, 5, 10, 20, 50, 100]


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of run tables by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def summarise(results: DataFrame, keys: Sequence[str], metrics: Sequence[str],
              digits: int | None = None, name: str = "{metric}_{stat}") -> DataFrame:
    """A1 (A2 with ``digits``): mean and sample std of each metric per group.
    NULL metrics are skipped; a single run gives a NULL std (T6).  Rounding
    is half-up (``round_fixed``)."""
    aggs = []
    for m in metrics:
        mean, std = F.avg(m), F.stddev_samp(m)
        if digits is not None:
            mean, std = round_fixed(mean, digits), round_fixed(std, digits)
        aggs += [mean.alias(name.format(metric=m, stat="mean")),
                 std.alias(name.format(metric=m, stat="std"))]
    return results.groupBy(*keys).agg(*aggs)


def main_results(summary: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                 name: str = "{metric}_{stat}") -> DataFrame:
    """A3: means only, named after the metric."""
    return summary.select(*keys, *[F.col(name.format(metric=m, stat="mean")).alias(m)
                                   for m in metrics])


def display_table(summary: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                  name: str = "{metric}_{stat}", na_text: str | None = "NA") -> DataFrame:
    """``mean ± std`` text cells (4 places)."""
    return summary.select(*keys, *[
        mean_std_text(name.format(metric=m, stat="mean"), name.format(metric=m, stat="std"),
                      na_text).alias(m) for m in metrics])


def fill_mean_std(df: DataFrame, metrics: Sequence[str], name: str = "{metric}_{stat}") -> DataFrame:
    """mean and std columns that a report lacks, from its ``mean ± std``
    texts (std 0 without ``±``, both NULL where the text is no number); columns
    that are there stay, metrics without a text column are left out."""
    have, out = set(df.columns), {}
    for m in metrics:
        mean, std = name.format(metric=m, stat="mean"), name.format(metric=m, stat="std")
        if mean not in have and m in have:
            value = mean_of(F.col(m).cast("string"))
            out[mean] = value
            out[std] = F.when(value.isNotNull(), std_of(F.col(m).cast("string")))
    return df.withColumns(out) if out else df


def class_distribution(df: DataFrame, target: str, labels: Mapping | None = None) -> DataFrame:
    """A4: count and percentage (2 places) per class, with readable labels."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # over <= #classes rows
    out = counts.withColumn("percentage", round_half_up_ratio(F.col("count"), total, 2, 100))
    if labels:
        lab = None
        for k, v in labels.items():
            lab = (F.when(F.col(target) == F.lit(k), F.lit(v)) if lab is None
                   else lab.when(F.col(target) == F.lit(k), F.lit(v)))
        out = out.withColumn("label", lab.otherwise(F.col(target).cast("string")))
    return out


def model_family(model) -> Column:
    m = F.col(model) if isinstance(model, str) else model
    return (F.when(m.contains("Logistic"), F.lit("LR"))
             .when(m.contains("Random Forest"), F.lit("RF")).otherwise(F.lit("other")))


def techniques(model) -> Column:
    """Techniques a run belongs to (an array): a privacy run and the baseline
    of hidden scoring to one, a plain baseline to all that share it."""
    m = F.col(model) if isinstance(model, str) else model
    one = [("HE ", "HE"), ("Normal", "HE"), ("DP ", "DP"), ("Federated", "FL"),
           ("K-anonymised", "K-anonymity")]
    expr = None
    for mark, name in one:
        c, v = m.contains(mark), F.array(F.lit(name))
        expr = F.when(c, v) if expr is None else expr.when(c, v)
    return expr.otherwise(F.array(F.lit("DP"), F.lit("FL"), F.lit("K-anonymity")))


def is_baseline(setting) -> Column:
    """case-insensitive 'baseline' test, NULL -> False."""
    s = F.col(setting) if isinstance(setting, str) else setting
    return F.coalesce(F.lower(s).contains("baseline"), F.lit(False))


def with_baseline(summary: DataFrame, model: str, setting: str, cols: Sequence[str],
                  by: Sequence[str] = (), prefix: str = "base_") -> DataFrame:
    """Attach the baseline row of the same model family to every
    non-baseline row.  When several baseline rows exist the first by model
    name is used.  The baseline table has one row per (by, family)."""
    fam = model_family(model)
    base = (summary.where(is_baseline(setting)).withColumn("_fam", fam)
            .groupBy(*by, "_fam")
            .agg(*[F.min_by(F.col(c), F.col(model)).alias(prefix + c) for c in cols]))
    rows = summary.where(~is_baseline(setting)).withColumn("_fam", fam)
    return rows.join(base, [*by, "_fam"], "left").drop("_fam")


def dp_order(model: str, setting: str) -> list[Column]:
    """DP rows by ε descending (LR before RF), baselines last."""
    s, m = F.col(setting), F.col(model)
    base = s.contains("Baseline")
    return [F.when(base, F.lit(99.0)).otherwise(-epsilon_of(s)).alias("order_1"),
            F.when(base, F.when(m == "Logistic Regression", 0).otherwise(1))
             .otherwise(F.when(m.contains("Logistic"), 0).otherwise(1)).alias("order_2")]


def fl_order(model: str, setting: str) -> list[Column]:
    """FL settings in their fixed order, baselines last."""
    s, m = F.col(setting), F.col(model)
    srank = (F.when(s == "Baseline (No Privacy)", 99)
             .when(s.contains("3 clients, 10 rounds"), 1)
             .when(s.contains("5 clients, 20 rounds"), 2)
             .when(s.contains("10 clients, 20 rounds"), 3).otherwise(98))
    mrank = (F.when(m.isin("Federated Logistic Regression", "Logistic Regression"), 0)
             .when(m.isin("Federated Random Forest", "Random Forest"), 1).otherwise(2))
    return [srank.cast("double").alias("order_1"), mrank.alias("order_2")]


def k_order(model: str, setting: str) -> list[Column]:
    """Position of k in the k list, 98 for other k, 99 for baselines."""
    s, m = F.col(setting), F.col(model)
    k = k_of(s)
    pos = F.array_position(F.array(*[F.lit(x) for x in K_ORDER]), k) - 1
    srank = (F.when(s.contains("Baseline"), 99)
             .when(k.isNotNull() & (pos >= 0), pos).otherwise(98))
    mrank = (F.when(m.contains("Logistic"), 0).when(m.contains("Random Forest"), 1).otherwise(2))
    return [srank.cast("double").alias("order_1"), mrank.alias("order_2")]


def he_order(model: str, setting: str) -> list[Column]:
    """Plain baseline first, hidden scoring second."""
    s, m = F.col(setting), F.col(model)
    rank = (F.when(m.contains("Normal") | (m == "Logistic Regression") | s.contains("Baseline"), 0)
             .when(m.contains("HE"), 1).otherwise(2))
    return [rank.cast("double").alias("order_1"), F.lit(0).alias("order_2")]


#: Fixed format: the mean of a ``mean ± std`` text.
MEAN_TEXT = r"^\s*([+-]?[0-9.]+)\s*±"


def runtime_column(df: DataFrame, names: Sequence[str] = ("Runtime Seconds", "Train Time (s)"),
                   out: str = "runtime") -> DataFrame:
    """The run-time column under whichever name the table uses; the mean
    of its ``mean ± std`` text if only that is there."""
    have = [c for c in names if c in df.columns]
    texts = [f"{c} mean ± std" for c in names if f"{c} mean ± std" in df.columns]
    if texts and not have:
        mean = F.regexp_extract(F.coalesce(*[F.col(f"`{c}`") for c in texts]), MEAN_TEXT, 1)
        return df.withColumn(out, mean.try_cast("double"))
    if not have:
        raise ValueError(f"no run-time column; expected one of {list(names)}")
    return df.withColumn(out, F.coalesce(*[F.col(c) for c in have]))
