"""Evaluation (A11, A12): confusion rows and classification metrics.

One ``groupBy(keys)`` with ``count_if`` per cell covers every seed, model
and setting at once; the group keys are runs, so the aggregate output is
tiny however many rows are scored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privtab.functions.exprs import ratio

METRICS = ["accuracy", "f1", "precision", "recall"]


def _cells(actual: str, predicted: str):
    a, p = F.col(actual), F.col(predicted)
    return {
        "tn": F.count_if((a == 0) & (p == 0)),
        "fp": F.count_if((a == 0) & (p == 1)),
        "fn": F.count_if((a == 1) & (p == 0)),
        "tp": F.count_if((a == 1) & (p == 1)),
    }


def confusion(preds: DataFrame, keys: Sequence[str], actual: str = "actual",
              predicted: str = "predicted") -> DataFrame:
    """Long confusion rows (keys, actual_class, predicted_0,
    predicted_1); both actual classes always present, absent cells 0."""
    cells = _cells(actual, predicted)
    agg = preds.groupBy(*keys).agg(*[v.alias(k) for k, v in cells.items()])
    rows = F.array(
        F.struct(F.lit(0).alias("actual_class"), F.col("tn").alias("predicted_0"),
                 F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual_class"), F.col("fn").alias("predicted_0"),
                 F.col("tp").alias("predicted_1")))
    return agg.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def _from_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select(
        *keys,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"))


def evaluate(preds: DataFrame, keys: Sequence[str], actual: str = "actual",
             predicted: str = "predicted") -> DataFrame:
    """Accuracy, F1, precision, recall per run (0 when undefined, T7)."""
    cells = _cells(actual, predicted)
    agg = preds.groupBy(*keys).agg(*[v.alias(k) for k, v in cells.items()])
    return _from_cells(agg, keys)


def metrics_from_confusion(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A11 -> A12: metrics from long confusion rows."""
    a = F.col("actual_class")
    agg = conf.groupBy(*keys).agg(
        F.sum(F.when(a == 0, F.col("predicted_0"))).alias("tn"),
        F.sum(F.when(a == 0, F.col("predicted_1"))).alias("fp"),
        F.sum(F.when(a == 1, F.col("predicted_0"))).alias("fn"),
        F.sum(F.when(a == 1, F.col("predicted_1"))).alias("tp"))
    agg = agg.na.fill(0, ["tn", "fp", "fn", "tp"])
    return _from_cells(agg, keys)
