"""V2, V5: logistic regression per site, solved on the executors.

The objective is that of ``logreg``.  The number of sites may grow with the
data, so nothing of a site reaches the driver: a step sums each site's gradient
and Hessian (map-side first, so a site may hold any share of the rows), Arrow
batches of these sums are solved, and coefficients are a stored table (site,
beta, state) that meets the rows again by a checked broadcast.  Only the number
of steps still to take is asked for.  The rows of a fit are stored once, with
flat columns; the sums are numbers only, so that they are summed by hash: an
array among them would sort all rows by site at every step.

``state`` tells what became of a site: ``done``, ``one class`` (no finite fit),
``diverged`` or ``not converged``; beta is NULL but for ``done``.  No site stops
another.  Rows without a site, label or any feature are in no fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField, StructType)

from privtab.functions.exprs import sigmoid, threshold
from privtab.session import materialize, small_table

#: A step beyond this in any coefficient counts as diverging.
FARTHEST = 1e8
#: Numbers of the Hessians that are solved at once.
AT_ONCE = 1 << 20


def _base(df: DataFrame, features: Sequence[str], label: str, group: str, weight: str | None) -> DataFrame:
    """(group, _x0.. the features, _y, _w) of the rows that can be fitted."""
    xs = [F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(group), *xs, F.col(label).cast("double").alias("_y"), w.alias("_w"))
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rows.columns]))


def _sums(base: DataFrame, beta: DataFrame | None, group: str, p: int) -> DataFrame:
    """Per site: beta, row sums of the gradient and the upper Hessian, and the
    classes met; sites without coefficients are left out."""
    x = [F.col(f"_x{j}") for j in range(p - 1)] + [F.lit(1.0)]
    if beta is None:
        rows = base.withColumn("_p", F.lit(0.5))
    else:
        rows = base.join(beta.select(group, *[F.col("beta")[j].alias(f"_b{j}") for j in range(p)]), group)
        score = reduce(lambda a, b: a + b, [x[j] * F.col(f"_b{j}") for j in range(p)])
        rows = rows.withColumn("_p", sigmoid(score))
    r = F.col("_w") * (F.col("_p") - F.col("_y"))
    h = F.col("_w") * F.col("_p") * (F.lit(1.0) - F.col("_p"))
    sums = [F.sum(r * x[j]) for j in range(p)] + [F.sum(h * x[j] * x[k]) for j in range(p) for k in range(j, p)]
    names = [f"_s{i}" for i in range(len(sums))]
    met = rows.groupBy(group).agg(*[c.alias(n) for c, n in zip(sums, names)], F.min("_y").alias("_low"), F.max("_y").alias("_high"))
    met = met.select(group, F.array(*names).alias("sums"), (F.col("_low") == F.col("_high")).alias("one_class"))
    if beta is None:
        return met.withColumn("beta", F.array(*[F.lit(0.0)] * p))
    return met.join(beta.select(group, "beta"), group)


def solve_steps(beta: np.ndarray, sums: np.ndarray, l2: float) -> np.ndarray:
    """Newton steps of many sites: (sites, p) from their coefficients and sums;
    NaN where the Hessian is singular."""
    n, p = beta.shape
    ridge = np.full(p, l2)
    ridge[-1] = 0.0  # the intercept is free
    rows, cols = np.triu_indices(p)
    out = np.empty((n, p))
    size = max(1, AT_ONCE // (p * p))
    for at in range(0, n, size):
        part = slice(at, at + size)
        hess = np.zeros((len(beta[part]), p, p))
        hess[:, rows, cols] = hess[:, cols, rows] = sums[part, p:]
        hess += np.diag(ridge + 1e-12)
        grad = sums[part, :p] + ridge * beta[part]
        try:
            out[part] = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # one of them: each by itself
            for i in range(len(grad)):
                try:
                    out[at + i] = np.linalg.solve(hess[i], grad[i])
                except np.linalg.LinAlgError:
                    out[at + i] = np.nan
    return out


def _solved(sums: DataFrame, group: str, p: int, l2: float, tol: float, flag: bool) -> DataFrame:
    """(group, beta, state) after a step.  Without ``flag`` (a fixed number of
    steps) every site stays open, and one that diverges keeps its coefficients."""
    schema = StructType([sums.schema[group], StructField("beta", ArrayType(DoubleType())), StructField("state", StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            old = np.asarray(batch.column("beta").flatten()).reshape(n, p)
            by = solve_steps(old, np.asarray(batch.column("sums").flatten()).reshape(n, -1), l2)
            bad = ~(np.abs(by).max(axis=1) < FARTHEST)  # NaN too
            new = np.where(bad[:, None], old, old - by)
            state = np.full(n, "open", dtype=object)
            if flag:
                state[np.abs(by).max(axis=1) < tol] = "done"
                state[bad] = "diverged"
                state[np.asarray(batch.column("one_class").to_pylist(), dtype=bool)] = "one class"
            lists = [b if s in ("open", "done") else None for b, s in zip(new.tolist(), state)]
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(lists, pa.list_(pa.float64())),
                                              pa.array(state, pa.string())], names=[group, "beta", "state"])

    return sums.select(group, "beta", "sums", "one_class").mapInArrow(step, schema)


def fit_sites(df: DataFrame, features: Sequence[str], label: str, group: str, weight: str | None = None,
              l2: float = 1.0, max_iter: int = 50, tol: float = 1e-9) -> DataFrame:
    """One L2 model per value of ``group``: (group, beta: coefficients and
    intercept, state).  A site that is settled leaves the later steps."""
    p = len(features) + 1
    base = materialize(_base(df, features, label, group, weight))
    settled, live = [], None
    for _ in range(max_iter):
        stepped = small_table(_solved(_sums(base, live, group, p), group, p, l2, tol, True), "fits")
        settled.append(stepped.where("state <> 'open'"))
        live = stepped.where("state = 'open'")
        if live.isEmpty():
            break
    else:
        settled.append(live.select(group, F.lit(None).cast("array<double>").alias("beta"),
                                   F.lit("not converged").alias("state")))
    return small_table(reduce(DataFrame.unionAll, settled), "fits")


def average_sites(df: DataFrame, features: Sequence[str], label: str, federation: str, rounds: Mapping, group: str,
                  weight: str | None = None, local_steps: int = 1, l2: float = 1.0) -> DataFrame:
    """V5: (federation, beta) after ``rounds[federation]`` rounds.  In a round
    every site takes ``local_steps`` Newton steps from its federation's
    coefficients, which become the mean of the sites', weighed by their rows.
    Site names are unique over all federations."""
    p = len(features) + 1
    kind = StructType([StructField(federation, df.schema[federation].dataType), StructField("_rounds", LongType()),
                       StructField("beta", ArrayType(DoubleType()))])
    zero = df.sparkSession.createDataFrame([(f, int(n), [0.0] * p) for f, n in rounds.items()], kind)
    base = materialize(_base(df, features, label, group, weight))
    sizes = df.where(F.col(group).isNotNull()).groupBy(federation, group).agg(F.count(F.lit(1)).alias("_n"))
    sites = small_table(sizes.join(zero, federation), "sites")  # every site with its federation's coefficients
    mean = F.array(*[F.sum(F.col("beta")[j] * F.col("_n")) / F.sum("_n") for j in range(p)])
    for t in range(max(rounds.values(), default=0)):
        live = sites.where(F.col("_rounds") > t)
        fits = live
        for s in range(local_steps):
            fits = _solved(_sums(base, fits, group, p), group, p, l2, 0.0, False)
            if s + 1 < local_steps:
                fits = small_table(fits, "fits")
        met = live.drop("beta").join(fits, group).groupBy(federation).agg(mean.alias("_mean"))
        sites = small_table(sites.join(met, federation, "left").select(
            federation, group, "_n", "_rounds", F.coalesce("_mean", "beta").alias("beta")), "sites")
    found = sites.groupBy(federation).agg(F.max("beta").alias("_found"))  # all sites hold the same
    return small_table(zero.join(found, federation, "left").select(
        federation, F.coalesce("_found", "beta").alias("beta")), "federations")


def label_by_table(df: DataFrame, fits: DataFrame, features: Sequence[str], group: str, out: str = "predicted",
                   prob: str | None = None) -> DataFrame:
    """Label rows by their group's model of a table (group, beta); without a
    model NULL."""
    met = df.join(fits.select(group, F.col("beta").alias("_beta")), group, "left")
    p = sigmoid(_score(F.col("_beta"), features))
    met = met.withColumn(out, threshold(p))
    return (met.withColumn(prob, p) if prob else met).drop("_beta")


def _score(beta: Column, features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).cast("double") * beta[j] for j, c in enumerate(features)], beta[len(features)])


def label_by_sites(test: DataFrame, models: DataFrame, features: Sequence[str], federation: str, site: str,
                   prob: str = "prob", out: str = "predicted") -> DataFrame:
    """V4 with a table (federation, site, beta): the mean probability of the
    federation's site models, in order of site; sites without a model do not
    count, a federation without any gives NULL.  The models of a federation are
    one value (8 bytes a coefficient): every row is scored by each of them."""
    held = small_table(models.where("beta IS NOT NULL").groupBy(federation).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(site).alias("site"), "beta"))),
                    lambda m: m["beta"]).alias("_sites")), "models")
    met = test.join(held, federation, "left")
    total = F.aggregate("_sites", F.lit(0.0), lambda acc, beta: acc + sigmoid(_score(beta, features)))
    return (met.withColumn(prob, total / F.size("_sites")).withColumn(out, threshold(F.col(prob))).drop("_sites"))
