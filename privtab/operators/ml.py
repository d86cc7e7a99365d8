"""Models (L1-L3) on Spark ML, configured to the reference objective.

* L1: scikit-learn's default L2 logistic regression minimises
  ``Σ w_i loss_i + ½‖β‖²`` with a free intercept; Spark ML minimises the
  weighted MEAN loss + (reg/2)‖β‖², so ``regParam = 1 / Σ w`` with
  ``standardization=False`` gives the same optimum.
* L2: random forest with explicit tree count and depth (Spark's defaults are
  20 trees of depth 5).
* L3: probabilities come back as a column (``vector_to_array``), never as
  driver-side arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="keep").transform(df)


def fit_lr(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
           max_iter: int = 1000, tol: float = 1e-10):
    """L1: L2 logistic regression, C = 1, plain or class-weighted."""
    total = train.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    if not total:
        raise ValueError("no training rows")
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, tol=tol,
                            regParam=1.0 / float(total), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(assemble(train.withColumn(label, F.col(label).cast("double")), features))


def fit_rf(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
           num_trees: int = 100, max_depth: int = 12, seed: int = 42):
    """L2: random forest (explicit trees and depth), plain or class-weighted."""
    # node-id caching and a larger per-pass node budget cut the number of
    # passes over the data for deep trees (performance only)
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, featureSubsetStrategy="sqrt",
                                cacheNodeIds=True, maxMemoryInMB=512)
    if weight:
        rf = rf.setWeightCol(weight)
    return rf.fit(assemble(train.withColumn(label, F.col(label).cast("double")), features))


def predict(model, df: DataFrame, features: Sequence[str], prob: str = "prob",
            out: str = "predicted") -> DataFrame:
    """L3: positive-class probability and label (>= 0.5) as columns."""
    scored = model.transform(assemble(df, features))
    scored = scored.withColumn(prob, vector_to_array(F.col("probability"))[1])
    scored = scored.withColumn(out, F.when(F.col(prob) >= 0.5, 1).otherwise(0))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def lr_weights(model, features: Sequence[str]) -> tuple[dict, float]:
    """Exported coefficients (for L4 / M1 scoring)."""
    return ({c: float(w) for c, w in zip(features, model.coefficients.toArray())},
            float(model.intercept))
