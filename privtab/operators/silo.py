"""Site-partitioned learning (V1-V6), re-aimed from a federated simulation.

Sites are a column (``silo``) on one DataFrame — assigned by ``assign_silo``
(W2) or taken from a real site column.  Per-site models are fitted for all
sites in the same jobs (a group key in the Newton aggregates); no site is
ever loaded into one worker.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privtab.functions.exprs import sigmoid, threshold
from privtab.operators.encode import balanced_weights
from privtab.operators.forest import BINS, bins_of, forest_votes, label_rows
from privtab.operators.logreg import coef_table
from privtab.operators.sitefit import average_sites, fit_sites
from privtab.session import small_table


def fit_lr_by_silo(train: DataFrame, features: Sequence[str], label: str,
                   silo: str = "silo", balanced: bool = True) -> DataFrame:
    """V2: balanced L2 logistic regression per site, all sites per job, as a
    table (silo, beta, state)."""
    df = balanced_weights(train, label, by=[silo], out="_bw") if balanced else train
    return fit_sites(df, features, label, silo, weight="_bw" if balanced else None)


def ensemble_by_silo(test: DataFrame, models: dict, features: Sequence[str],
                     group: str | None = None, prob: str = "prob",
                     out: str = "predicted") -> DataFrame:
    """V4: unweighted mean of the site models' probabilities, label >= 0.5.
    (Refitting a deterministic site model each round gives the same model,
    so the mean over rounds equals the mean over sites.)

    ``models``: ``{site: (coef, intercept)}``; with ``group``, one such dict
    per value of that column, all with equally many sites."""
    if group is None:
        return ensemble_by_silo(test.withColumn("_all", F.lit(0)), {0: models}, features, "_all",
                                prob, out).drop("_all")
    flat = {g: [v for _, (coef, b) in sorted(m.items()) for v in (*coef, b)]
            for g, m in models.items()}
    n_sites, step = {len(m) for m in models.values()}, len(features) + 1
    if len(n_sites) != 1:
        raise ValueError("every group needs the same number of site models")
    n = n_sites.pop()
    df = test.join(coef_table(test, flat, group, "_site"), group, "left")
    total = F.lit(0.0)
    for i in range(n):
        s = F.col("_site")[i * step + len(features)]
        for j, c in enumerate(features):
            s = s + F.col(c).cast("double") * F.col("_site")[i * step + j]
        total = total + sigmoid(s)
    return (df.withColumn(prob, total / F.lit(float(n)))
              .withColumn(out, threshold(F.col(prob))).drop("_site"))


def rf_by_silo(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, federation: str,
               trees, silo: str = "silo", balanced: bool = True, bins: int = BINS, out: str = "predicted") -> DataFrame:
    """V3 + V4: a balanced forest for every site of every federation (a column),
    all in the same jobs; a test row gets the mean probability over the trees of
    its federation's sites, label 1 from one half on.

    ``trees``: a number or a column over ``train``, the trees of each of a
    federation's sites (trees of a round times rounds).  ``train`` has the
    federation, the site (named apart from those of other federations) and
    ``seed``; ``test`` the federation.  A federation without sites gives NULL."""
    fit_on = train.withColumn("trees", trees if isinstance(trees, Column) else F.lit(trees))
    sites = small_table(fit_on.select(federation, silo, "seed", "trees").distinct(), "sites")
    # a row of every cell of a federation (its least values) before they meet the sites
    least = test.groupBy(federation, bins_of(features, bins).alias("_cell")).agg(
        *[F.min(F.col(c).cast("double")).alias(c) for c in features])
    each = least.drop("_cell").join(sites, federation)
    votes = forest_votes(fit_on, each, features, label, key, silo, balanced, bins)
    sums = (votes.join(sites, silo).groupBy(federation, "bins").agg(F.sum("votes").alias("votes")))
    whole = small_table(sites.groupBy(federation).agg(F.sum("trees").alias("_trees")), "federations")
    met = test.join(whole, federation, "left")
    return label_rows(met, sums, features, [federation], F.col("_trees"), bins, out).drop("_trees")


def fed_avg(train: DataFrame, features: Sequence[str], label: str, silo: str = "silo",
            rounds: int = 10, local_steps: int = 1, balanced: bool = True) -> tuple:
    """V5: weighted parameter averaging.  Each round every site takes
    ``local_steps`` Newton steps from the global coefficients (all sites in
    one aggregate per step); the new global coefficients are the average of
    the sites' weighted by their row counts.  One site => plain L1 fit."""
    one = train.withColumn("_fed", F.lit(0))
    return fed_avg_many(one, features, label, "_fed", {0: rounds}, silo, local_steps, balanced)[0]


def fed_avg_many(train: DataFrame, features: Sequence[str], label: str, federation: str,
                 rounds: Mapping, silo: str = "silo", local_steps: int = 1,
                 balanced: bool = True) -> dict:
    """V5 for several federations (a column) in the same jobs; ``rounds`` per
    federation, site names unique over all; ``{federation: (coef, intercept)}``."""
    fits = fed_avg_table(train, features, label, federation, rounds, silo, local_steps, balanced)
    got = fits.collect()  # one row per federation, named by the caller
    return {r[0]: (np.array(r["beta"][:-1]), float(r["beta"][-1])) for r in got}


def fed_avg_table(train: DataFrame, features: Sequence[str], label: str, federation: str,
                  rounds: Mapping, silo: str = "silo", local_steps: int = 1,
                  balanced: bool = True) -> DataFrame:
    """V5 as a table (federation, beta); the sites stay in Spark."""
    df = balanced_weights(train, label, by=[silo], out="_bw") if balanced else \
        train.withColumn("_bw", F.lit(1.0))
    return average_sites(df, features, label, federation, rounds, silo, "_bw", local_steps)
