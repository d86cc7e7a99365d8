"""Linear scoring (L4, F11) and probability averaging over models.

Scores are sums of column x literal products: JVM-side, inside codegen,
one pass, no UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privtab.functions.exprs import sigmoid, threshold


def score_expr(weights: Mapping[str, float], bias: float = 0.0) -> Column:
    """``bias + Σ w_j * x_j`` as one expression."""
    s = F.lit(float(bias))
    for c, w in weights.items():
        s = s + F.col(c).cast("double") * F.lit(float(w))
    return s


def linear_score(df: DataFrame, weights: Mapping[str, float], bias: float = 0.0,
                 prob: str = "prob", label: str = "label", score: str | None = "score") -> DataFrame:
    """L4: score, sigmoid probability and label (>= 0.5) from exported weights."""
    s = score_expr(weights, bias)
    out = df.withColumn(score or "_score", s)
    out = out.withColumn(prob, sigmoid(F.col(score or "_score")))
    out = out.withColumn(label, threshold(F.col(prob)))
    return out if score else out.drop("_score")


def ensemble_mean(df: DataFrame, models: Sequence[tuple[Mapping[str, float], float]],
                  prob: str = "prob", label: str = "label") -> DataFrame:
    """V4: unweighted mean of every model's positive-class probability;
    label 1 when the mean is >= 0.5 (T11)."""
    probs = [sigmoid(score_expr(w, b)) for w, b in models]
    mean = probs[0]
    for p in probs[1:]:
        mean = mean + p
    mean = mean / F.lit(float(len(probs)))
    return df.withColumn(prob, mean).withColumn(label, threshold(F.col(prob)))


def ensemble_prob_columns(df: DataFrame, cols: Sequence[str], prob: str = "prob",
                          label: str = "label") -> DataFrame:
    """V4 over probability columns already on the rows."""
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / F.lit(float(len(cols)))
    return df.withColumn(prob, mean).withColumn(label, threshold(F.col(prob)))
