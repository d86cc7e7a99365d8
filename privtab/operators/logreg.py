"""L2 logistic regression by Newton steps over DataFrame aggregates.

Objective per group g (sites, seeds, ...)::

    Σ_i w_i * logloss(y_i, σ(β·x_i + β0)) + (l2/2)‖β‖² + bᵀβ

(``b`` is an optional linear term, used by objective perturbation).  Each
Newton step is ONE aggregate job: every row contributes its gradient and
Hessian terms, partial sums combine map-side and only (d+1) + (d+1)(d+2)/2
numbers per group reach the driver, which solves all groups' steps at
once.  Rows never leave the executors and no group is gathered into one
task, whatever its size.

With ``l2 = 1`` and unit weights this is scikit-learn's default
``LogisticRegression`` objective (C = 1, free intercept).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


#: Largest coefficient table (bytes) that is sent to every executor; beyond it
#: the join is left to the engine.
BROADCAST_BYTES = 8 << 20


def coef_table(df: DataFrame, coefs: Mapping, group: str, out: str = "_b") -> DataFrame:
    """Coefficients as a table (group, array of double), one row per group."""
    dtype = df.schema[group].dataType
    width = max((len(c) for c in coefs.values()), default=0)
    t = df.sparkSession.createDataFrame(
        [(g, [float(v) for v in c]) for g, c in coefs.items()],
        StructType([StructField(group, dtype), StructField(out, ArrayType(DoubleType()))]))
    return F.broadcast(t) if len(coefs) * (8 * width + 64) <= BROADCAST_BYTES else t


def newton_lr(df: DataFrame, features: Sequence[str], label: str,
              weight: str | None = None, group: str | None = None, l2=1.0,
              fit_intercept: bool = True, linear_term: Mapping | None = None,
              max_iter: int = 50, tol: float = 1e-9, persist: bool = True,
              init: Mapping | None = None, require: bool = True) -> dict:
    """Fit one model per value of ``group`` (or one model when None).

    Returns ``{group_value: (coef ndarray(d), intercept float)}``.
    ``linear_term``: ``{group_value: ndarray(d [+1])}`` added to the gradient.
    ``init``: starting ``{group_value: ndarray(d [+1])}`` (default zeros).
    ``l2``: a number, or ``{group_value: number}`` for per-group ridge.
    A fit that has not converged after ``max_iter`` steps raises, unless
    ``require`` is false (a fixed number of steps).  With an intercept, a group
    whose rows have one class has no finite fit: it is left out of the result
    (its rows get NULL labels) and does not stop the others; without groups it
    raises.
    """
    feats = list(features)
    d = len(feats)
    p = d + (1 if fit_intercept else 0)
    cols = [F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(feats)]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.select(*cols, F.col(label).cast("double").alias("_y"), w.alias("_w"),
                     *([F.col(group).alias("_g")] if group else []))
    if persist:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    gcol = "_g" if group else None
    # groups come from the init table, or from the first step's aggregate
    # (all coefficients start at zero, so that step needs no group lookup)
    groups = sorted(init) if (group and init is not None) else ([] if group else [None])
    coefs = {g: np.array(init[g], dtype=float) for g in groups} if (group and init) \
        else {g: np.zeros(p) for g in groups}
    xs = [F.col(f"_x{j}") for j in range(d)] + ([F.lit(1.0)] if fit_intercept else [])
    def penal_of(g):
        lam = l2[g] if isinstance(l2, Mapping) else l2
        return np.array([float(lam)] * d + ([0.0] if fit_intercept else []))
    try:
        for _ in range(max_iter):
            rows_in, score = base, F.lit(0.0)
            if group and groups:  # rows of groups without coefficients are left out
                rows_in = base.join(coef_table(base, coefs, "_g"), "_g")
                for j in range(p):
                    score = score + xs[j] * F.col("_b")[j]
            elif groups:
                for j in range(p):
                    score = score + xs[j] * F.lit(float(coefs[None][j]))
            rows_in = rows_in.withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-score)))
            r = F.col("_w") * (F.col("_p") - F.col("_y"))
            h = F.col("_w") * F.col("_p") * (F.lit(1.0) - F.col("_p"))
            aggs = [F.sum(r * xs[j]).alias(f"g{j}") for j in range(p)]
            aggs += [F.sum(h * xs[j] * xs[k]).alias(f"h{j}_{k}")
                     for j in range(p) for k in range(j, p)]
            aggs += [F.min("_y").alias("_low"), F.max("_y").alias("_high")]
            grouped = rows_in.groupBy("_g") if group else rows_in.groupBy()
            rows = grouped.agg(*aggs).collect()  # one row per group
            max_step = 0.0
            if not groups:
                groups = sorted(row["_g"] for row in rows)
                coefs = {g: np.zeros(p) for g in groups}
            if fit_intercept and linear_term is None and require:
                one = [row["_g"] if group else None for row in rows if row["_low"] == row["_high"]]
                if one and not group:
                    raise ValueError("the rows have one class")
                for g in one:
                    coefs.pop(g, None)
            for row in rows:
                g = row["_g"] if group else None
                if g not in coefs:  # a group absent from ``init``
                    continue
                beta = coefs[g]
                penal = penal_of(g)
                grad = np.array([row[f"g{j}"] or 0.0 for j in range(p)]) + penal * beta
                if linear_term is not None:
                    grad = grad + np.asarray(linear_term[g], dtype=float)[:p]
                hess = np.zeros((p, p))
                for j in range(p):
                    for k in range(j, p):
                        hess[j, k] = hess[k, j] = row[f"h{j}_{k}"] or 0.0
                hess += np.diag(penal) + 1e-12 * np.eye(p)
                step = np.linalg.solve(hess, grad)
                coefs[g] = beta - step
                max_step = max(max_step, float(np.max(np.abs(step))))
            if max_step < tol:
                break
        else:
            if require:
                raise RuntimeError(f"no convergence in {max_iter} Newton steps (last step {max_step:g})")
    finally:
        if persist:
            base.unpersist()
    return {g: ((c[:d], float(c[d])) if fit_intercept else (c, 0.0)) for g, c in coefs.items()}


def coef_dict(features: Sequence[str], coef) -> dict:
    return {c: float(v) for c, v in zip(features, coef)}


def predict_grouped(df: DataFrame, fits: dict, features: Sequence[str], group: str,
                    out: str = "predicted", prob: str | None = None) -> DataFrame:
    """Label rows with their own group's model (joined as a small table); a
    group without a model gives NULL."""
    d = len(features)
    models = {g: [*c, b] for g, (c, b) in fits.items()}
    df = df.join(coef_table(df, models, group, "_beta"), group, "left")
    score = F.col("_beta")[d]
    for j, c in enumerate(features):
        score = score + F.col(c).cast("double") * F.col("_beta")[j]
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
    df = df.withColumn(out, (p >= 0.5).cast("int"))
    return (df.withColumn(prob, p) if prob else df).drop("_beta")
