"""Differentially private learners.

D1 — ε-DP logistic regression by objective perturbation (Chaudhuri,
Monteleoni & Sarwate, JMLR 2011, Algorithm 2, c = 1/4).  Rows are clipped to
L2 norm 1 (after appending the intercept feature), a random linear term
``bᵀβ`` with density ∝ exp(-ε'‖b‖/2) is added to the objective, and the
perturbed objective is minimised by ``logreg.newton_lr`` (one aggregate job
per Newton step).

D2 — ε-DP random forest with data-independent trees: split features and
thresholds are drawn within the DECLARED feature bounds (never learned from
data), every row goes to exactly one tree by hash (disjoint subsets, so each
tree may spend the whole ε), and each leaf's label is chosen by the
exponential mechanism (Gumbel-max on counts, sensitivity 1).  The only data
job is one count by (group, tree, leaf, label), whatever the number of ε;
rows are then scored for every ε in one pass of Arrow batches.

Bounds are declared: ``declare`` scales and clips features to bounds that are
known without the data and gives a ``Bounded`` frame, which the fits take.
Scaling by minima and maxima of the data leaks them, so a frame from
``learned`` is refused unless the caller says that the fit is not private.

Noise is drawn on the driver (D1) or from keyed hashes (D2); pass
``seed=None`` to draw or key it from the operating system's secure source.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from privtab.functions.hashing import hash_bucket, hash_hex
from privtab.operators.encode import minmax_scale
from privtab.operators.forest import PRIME, draw
from privtab.operators.logreg import newton_lr


@dataclass(frozen=True)
class Bounded:
    """Rows whose ``features`` lie in [0, 1], and whether the bounds that they
    were scaled by were declared or learned from the rows."""

    rows: DataFrame
    features: tuple[str, ...]
    declared: bool

    def where(self, condition) -> Bounded:
        return Bounded(self.rows.where(condition), self.features, self.declared)

    def private_rows(self, non_private: bool = False) -> DataFrame:
        if not (self.declared or non_private):
            raise ValueError("features are scaled by learned bounds, which the privacy budget does not cover: "
                             "declare bounds, or pass non_private=True")
        return self.rows


def declare(df: DataFrame, bounds: Mapping[str, tuple[float, float]], suffix: str = "") -> Bounded:
    """Scale by declared (low, high) and clip to [0, 1]; NULL and NaN stay NULL."""
    out = {}
    for c, (low, high) in bounds.items():
        if not low < high:
            raise ValueError(f"bounds of {c}: {low} is not below {high}")
        x = (F.col(c).cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
        x = F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
        out[c + suffix] = x
    return Bounded(df.withColumns(out), tuple(out), True)


def learned(df: DataFrame, features: Sequence[str]) -> Bounded:
    """Min-max scaled by the rows themselves (E2): not private."""
    return Bounded(minmax_scale(df, list(features)), tuple(features), False)


def _rng(seed: int | None) -> np.random.Generator:
    return np.random.default_rng(secrets.randbits(128) if seed is None else seed)


def clip_rows(df: DataFrame, features: Sequence[str], norm: float = 1.0,
              intercept: bool = True, prefix: str = "_c") -> tuple[DataFrame, list[str]]:
    """Scale each row's feature vector (plus a constant 1 when ``intercept``)
    to L2 norm at most ``norm``; returns the frame and the clipped names."""
    xs = [F.col(c).cast("double") for c in features] + ([F.lit(1.0)] if intercept else [])
    sq = xs[0] * xs[0]
    for x in xs[1:]:
        sq = sq + x * x
    scale = F.greatest(F.lit(1.0), F.sqrt(sq) / F.lit(float(norm)))
    names = [f"{prefix}{j}" for j in range(len(xs))]
    out = df.select("*", *[(x / scale).alias(n) for x, n in zip(xs, names)])
    return out, names


def perturbation_terms(epsilon: float, n: int, d: int, seed: int | None,
                       c: float = 0.25) -> tuple[np.ndarray, float]:
    """Objective perturbation: the random vector b (sum-scale objective) and
    the extra ridge Δ (mean-scale), for λ = 1/n."""
    lam = 1.0 / n
    eps_p = epsilon - math.log(1.0 + 2.0 * c / (n * lam) + c * c / (n * n * lam * lam))
    delta = 0.0
    if eps_p <= 0:
        delta = c / (n * (math.exp(epsilon / 4.0) - 1.0)) - lam
        eps_p = epsilon / 2.0
    rng = _rng(seed)
    direction = rng.normal(size=d)
    direction /= np.linalg.norm(direction)
    radius = rng.gamma(shape=d, scale=2.0 / eps_p)
    # density exp(-ε'‖b‖/2) is for the mean-scale objective; the solver uses
    # sums, so the linear term is b (÷ n × n) and the ridge is n·Δ.
    return direction * radius, max(delta, 0.0)


def fit_dp_lr(train: Bounded, label: str, epsilon: float, seed: int | None = None,
              data_norm: float = 1.0, non_private: bool = False) -> dict:
    """Returns {'coef': ndarray over clipped features incl. intercept,
    'features': names, 'n': rows}."""
    return fit_dp_lr_sweep(train, label, [epsilon], seed, data_norm, non_private)[epsilon]


def fit_dp_lr_sweep(train: Bounded, label: str, epsilons: Sequence[float], seed: int | None = None,
                    data_norm: float = 1.0, non_private: bool = False) -> dict:
    """D1 for several ε at once: the clipped rows are repeated per ε (a
    generator) and every ε's perturbed objective is one group of the same
    Newton aggregates, so the sweep costs the jobs of a single fit."""
    features = train.features
    clipped, names = clip_rows(train.private_rows(non_private), features, data_norm, intercept=True)
    n = clipped.count()
    if n == 0:
        raise ValueError("no training rows")
    rng_seeds = {e: (None if seed is None else seed * 1000 + i) for i, e in enumerate(epsilons)}
    terms = {i: perturbation_terms(e, n, len(names), rng_seeds[e]) for i, e in enumerate(epsilons)}
    x = clipped.withColumn("_eps", F.explode(F.array(*[F.lit(i) for i in range(len(epsilons))])))
    fit = newton_lr(x, names, label, group="_eps", fit_intercept=False,
                    l2={i: 1.0 + n * t[1] for i, t in terms.items()},
                    linear_term={i: t[0] for i, t in terms.items()})
    return {e: {"coef": fit[i][0], "features": list(features), "norm": data_norm, "n": n}
            for i, e in enumerate(epsilons)}


def predict_dp_lr(df: DataFrame, model: dict, out: str = "predicted") -> DataFrame:
    """Label = sign of the clipped-row score (clipping scales by a positive
    factor, so the intercept-augmented raw row gives the same sign)."""
    xs = [F.col(c).cast("double") for c in model["features"]] + [F.lit(1.0)]
    s = F.lit(0.0)
    for x, w in zip(xs, model["coef"]):
        s = s + x * F.lit(float(w))
    return df.withColumn(out, F.when(s >= 0, 1).otherwise(0))


# ---------------------------------------------------------------- D2 forest

def random_trees(n_trees: int, depth: int, n_features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Data-independent trees over features in [0, 1]: (trees x nodes) feature
    places and thresholds of the 2^depth - 1 inner nodes.  The trees are public
    (only leaf labels are protected), so a hash draws them."""
    tree, node = np.arange(n_trees)[:, None], np.arange(2 ** depth - 1)[None, :]
    return (draw(seed, tree, node * 2) % n_features).astype(np.int64), draw(seed, tree, node * 2 + 1) / PRIME


def walk(x: np.ndarray, feats: np.ndarray, ths: np.ndarray, depth: int) -> np.ndarray:
    """Leaf (0-based) of every row (rows x features) in every tree; a missing
    value goes left."""
    trees = np.arange(len(feats))[None, :]
    node = np.zeros((len(x), len(feats)), np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, feats[trees, node]] > ths[trees, node])
    return node - (2 ** depth - 1)


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """Rows x features, NULL as NaN."""
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features], 1)


def forest_leaf_counts(df: DataFrame, features: Sequence[str], label: str, key: str, forests: Mapping, depth: int,
                       group: str | None = None) -> DataFrame:
    """D2 data pass: (group, tree, leaf, label, n).

    ``forests``: {group value: (features, thresholds)} of ``random_trees``; with
    ``group`` None one forest under the key None.  A row's tree comes from
    md5(group:key), with 0 for no group.  Tasks count before the shuffle."""
    n_trees = len(next(iter(forests.values()))[0])
    seed = F.lit(0) if group is None else F.col(group)
    tree = F.pmod(hash_bucket(hash_hex(seed, key), 8), F.lit(n_trees)).cast("int")
    named = (F.lit(None).cast("int") if group is None else F.col(group)).alias("grp")
    rows = df.select(named, tree.alias("tree"), F.col(label).cast("int").alias("label"),
                     *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
    kind = StructType([rows.schema["grp"], *StructType.fromDDL("tree int, leaf int, label int, n long").fields])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group_of = batch.column("grp").to_pylist()
            tree_of = batch.column("tree").to_numpy()
            label_of = batch.column("label").fill_null(-1).to_numpy()
            x = _matrix(batch, [f"x{j}" for j in range(len(features))])
            for g in set(group_of):
                at = np.flatnonzero([v == g for v in group_of])
                feats, ths = forests[g]
                node = np.zeros(len(at), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (x[at, feats[tree_of[at], node]] > ths[tree_of[at], node])
                code = np.stack([tree_of[at], node - (2 ** depth - 1), label_of[at]])
                found, n = np.unique(code, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(n), arrow[0].type), *[pa.array(c, pa.int32()) for c in found], pa.array(n)],
                    schema=arrow)

    keys = ["tree", "leaf", "label"]
    out = rows.mapInArrow(run, kind).groupBy("grp", *keys).agg(F.sum("n").alias("n"))
    out = out.withColumn("label", F.when(F.col("label") >= 0, F.col("label")))
    return out.drop("grp") if group is None else out.withColumnRenamed("grp", group)


def gumbel(seed, *keys):
    """Gumbel noise of (seed, keys): -ln(-ln u), u from 52 hash bits, never 0 or 1."""
    u = (hash_bucket(hash_hex(seed, *keys), 13).cast("double") + F.lit(0.5)) / F.lit(float(16 ** 13))
    return -F.log(-F.log(u))


def _secret_gumbel(salt: str, *keys):
    h = F.sha2(F.concat_ws(":", F.lit(salt), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]), 256)
    u = (hash_bucket(h, 13).cast("double") + F.lit(0.5)) / F.lit(float(16 ** 13))
    return -F.log(-F.log(u))


def noisy_leaf_labels(counts: DataFrame, n_trees: int, depth: int, epsilons: Sequence[float],
                      seed: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Exponential mechanism per leaf (Gumbel-max on ε·count/2) for every ε:
    (by.., e, tree, leaf, label), ``e`` the place of ε.  Leaves without rows
    get labels too.  Its rows are trees x leaves x ε (x ``by``), no data rows."""
    wide = counts.groupBy(*by, "tree", "leaf").agg(*[
        F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)])
    grid = (counts.select(*by).distinct() if by else counts.sparkSession.range(1).select())
    grid = (grid.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
            .withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(2 ** depth - 1)))))
    cells = grid.join(wide, [*by, "tree", "leaf"], "left").fillna(0, ["n0", "n1"])
    eps = F.explode(F.array(*[F.struct(F.lit(i).alias("e"), F.lit(float(v)).alias("eps")) for i, v in enumerate(epsilons)]))
    cells = cells.withColumn("_e", eps).select("*", "_e.e", "_e.eps").drop("_e")
    salt = secrets.token_hex(32) if seed is None else None

    def noise(k):
        keys = [*by, "e", "tree", "leaf", F.lit(k)]
        return _secret_gumbel(salt, *keys) if salt else gumbel(seed, *keys)

    score = [F.col("eps") * F.col(f"n{k}") / F.lit(2.0) + noise(k) for k in (0, 1)]
    return cells.select(*by, "e", "tree", "leaf", (score[1] > score[0]).cast("int").alias("label"))


def vote_rows(df: DataFrame, features: Sequence[str], forests: Mapping, depth: int, group: str | None = None,
              out: str = "votes") -> DataFrame:
    """Adds ``out``, an array with the number of trees that vote 1 for each ε.

    ``forests``: {group value: (features, thresholds, labels)}, ``labels`` an
    (ε x trees x leaves) array; a group without a forest gives NULL."""
    kind = StructType([*df.schema.fields, *StructType.fromDDL(f"{out} array<int>").fields])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, features)
            group_of = batch.column(group).to_pylist() if group else [None] * batch.num_rows
            votes = np.empty(batch.num_rows, object)
            for g in set(group_of):
                if g not in forests:
                    continue
                at = np.flatnonzero([v == g for v in group_of])
                feats, ths, labels = forests[g]
                leaf = walk(x[at], feats, ths, depth)
                trees = np.arange(len(feats))[None, :]
                sums = np.stack([own[trees, leaf].sum(1) for own in labels], 1)
                votes[at] = list(sums.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, pa.list_(pa.int32()))], schema=arrow)

    return df.mapInArrow(run, kind)


def label_arrays(labels: DataFrame, n_eps: int, n_trees: int, depth: int, by: str | None = None) -> dict:
    """Leaf labels as {group: (ε x trees x leaves) array}; the table's size is
    given by parameters, so it may come to the driver."""
    out: dict = {}
    for r in labels.toLocalIterator():
        table = out.setdefault(r[by] if by else None, np.zeros((n_eps, n_trees, 2 ** depth), np.int8))
        table[r["e"], r["tree"], r["leaf"]] = r["label"]
    return out


def fit_dp_forest(train: Bounded, label: str, key: str, epsilons: Sequence[float], n_trees: int = 100, depth: int = 5,
                  seed: int | None = None, seeds: Sequence[int] = (0,), group: str | None = None,
                  non_private: bool = False) -> dict:
    """One data-independent forest for every value in ``seeds`` (of column
    ``group``, or a single one), with ε-DP leaf labels for every ε: {'forests':
    {group: (features, thresholds, labels)}, ...}.  Leaves are counted once."""
    rows = train.private_rows(non_private)
    trees = {s if group else None: random_trees(n_trees, depth, len(train.features), s) for s in seeds}
    counts = forest_leaf_counts(rows, train.features, label, key, trees, depth, group)
    labels = noisy_leaf_labels(counts, n_trees, depth, epsilons, seed, [group] if group else [])
    tables = label_arrays(labels, len(epsilons), n_trees, depth, group)
    return {"forests": {g: (*trees[g], tables[g]) for g in tables}, "depth": depth, "features": train.features,
            "group": group, "epsilons": tuple(epsilons), "n_trees": n_trees}


def predict_dp_forest(df: DataFrame, model: dict, out: str = "predicted", prob: str | None = None) -> DataFrame:
    """One row for every row and ε (column ``epsilon``): the share of trees that
    vote 1, and label 1 where it is at least one half."""
    voted = vote_rows(df, model["features"], model["forests"], model["depth"], model["group"], "_votes")
    eps = F.array(*[F.lit(float(e)) for e in model["epsilons"]])
    each = voted.select(*df.columns, F.explode(F.arrays_zip(eps.alias("e"), F.col("_votes").alias("v"))).alias("_z"))
    share = F.col("_z.v") / F.lit(float(model["n_trees"]))
    each = each.withColumn("epsilon", F.col("_z.e")).withColumn(out, (share >= 0.5).cast("int"))
    return (each.withColumn(prob, share) if prob else each).drop("_z")
