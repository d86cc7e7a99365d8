"""Per-site solver: against single fits, plain numpy, awkward sites and many sites."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from privtab.operators import silo, sitefit
from privtab.operators.logreg import newton_lr

FEATS = ["a", "b", "c"]


def noisy(spark, n, sites):
    site = (F.xxhash64("id", F.lit(9)) % sites + sites) % sites
    unit = [((F.xxhash64("id", F.lit(j)) % 1000) / 1000.0).alias(c) for j, c in enumerate(FEATS)]
    df = spark.range(n).select(F.format_string("s%d", site.cast("long")).alias("site"), *unit, "id")
    noise = (F.xxhash64("id", F.lit(77)) % 1000) / 1000.0
    return df.withColumn("y", (F.col("a") - F.col("b") + noise > 0).cast("int"))


def test_sites_equal_single_fits(spark):
    df = noisy(spark, 2000, 5).cache()
    fits = {r.site: r for r in sitefit.fit_sites(df, FEATS, "y", "site").collect()}
    assert len(fits) == 5 and {r.state for r in fits.values()} == {"done"}
    for g, r in fits.items():
        coef, b = newton_lr(df.where(F.col("site") == g), FEATS, "y")[None]
        assert np.allclose(r.beta, [*coef, b], atol=1e-8)


def test_odd_sites_do_not_stop_the_others(spark):
    df = noisy(spark, 600, 2)
    ones = df.limit(30).withColumns({"site": F.lit("ones"), "y": F.lit(1)})
    nan = df.limit(30).withColumns({"site": F.lit("nan"), "a": F.lit(float("nan"))})
    gaps = df.limit(30).withColumns({"site": F.lit("s0"), "a": F.lit(None).cast("double")})
    nameless = df.limit(30).withColumn("site", F.lit(None).cast("string"))
    both = reduce_union(df, ones, nan, gaps, nameless).withColumn("beta", F.lit("x"))
    got = {r.site: r for r in sitefit.fit_sites(both, FEATS, "y", "site").collect()}
    assert {g: r.state for g, r in got.items()} == {"s0": "done", "s1": "done", "ones": "one class", "nan": "diverged"}
    assert got["ones"].beta is None and got["nan"].beta is None
    clean = {r.site: r.beta for r in sitefit.fit_sites(df, FEATS, "y", "site").collect()}
    assert all(np.allclose(got[g].beta, b) for g, b in clean.items())
    short = {r.site: r.state for r in sitefit.fit_sites(df, FEATS, "y", "site", max_iter=1).collect()}
    assert short == {"s0": "not converged", "s1": "not converged"}
    assert sitefit.fit_sites(df.where("false"), FEATS, "y", "site").count() == 0


def reduce_union(first, *others):
    for df in others:
        first = first.unionByName(df)
    return first


@pytest.mark.parametrize("steps", [1, 2])
def test_averaged_sites_equal_a_plain_loop(spark, steps):
    df = noisy(spark, 900, 3).withColumn("fed", F.when(F.col("site") == "s0", "p").otherwise("q"))
    got = {r.fed: r.beta for r in sitefit.average_sites(df, FEATS, "y", "fed", {"p": 2, "q": 3, "none": 4}, "site",
                                                       local_steps=steps).collect()}
    rows = df.collect()
    assert got["none"] == [0.0] * 4
    for fed, rounds in (("p", 2), ("q", 3)):
        beta = np.zeros(4)
        sites = sorted({r.site for r in rows if r.fed == fed})
        for _ in range(rounds):
            after, sizes = [], []
            for g in sites:
                x = np.array([[r.a, r.b, r.c, 1.0] for r in rows if r.site == g])
                y = np.array([r.y for r in rows if r.site == g])
                b = beta
                for _ in range(steps):
                    p = 1 / (1 + np.exp(-x @ b))
                    ridge = np.array([1.0, 1, 1, 0])
                    b = b - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * b)
                after.append(b)
                sizes.append(len(y))
            beta = np.average(after, axis=0, weights=sizes)
        assert np.allclose(got[fed], beta, atol=1e-8)


def test_site_tables_label_rows(spark):
    models = spark.createDataFrame([("f", 1, [1.0, 0.0]), ("f", 0, [-3.0, 1.0]), ("f", 2, None), ("g", 0, None)],
                                   "fed string, site int, beta array<double>")
    rows = spark.createDataFrame([("f", 0.5), ("f", -2.0), ("f", None), ("g", 1.0), ("h", 1.0), (None, 1.0)], "fed string, a double")
    got = sorted(((r.fed, r.a, r.prob, r.predicted) for r in sitefit.label_by_sites(rows, models, ["a"], "fed", "site").collect()), key=repr)
    for fed, a, prob, label in got:
        if fed != "f" or a is None:
            assert prob is None and label is None
        else:
            want = (1 / (1 + np.exp(-a)) + 1 / (1 + np.exp(-(1 - 3 * a)))) / 2
            assert abs(prob - want) < 1e-12 and label == int(want >= 0.5)
    alone = sitefit.label_by_table(rows, models.where("site = 1"), ["a"], "fed").collect()
    assert sorted(((r.fed, r.a, r.predicted) for r in alone), key=repr) == sorted(
        [("f", 0.5, 1), ("f", -2.0, 0), ("f", None, None), ("g", 1.0, None), ("h", 1.0, None), (None, 1.0, None)], key=repr)


def test_a_singular_site_leaves_the_others():
    sums = np.array([[1.0, 1.0, 1e6, 1e6, 1e6], [1.0, 2.0, 2.0, 0.0, 4.0]])
    by = sitefit.solve_steps(np.zeros((2, 2)), sums, 0.0)
    assert np.isnan(by[0]).all() and np.allclose(by[1], [0.5, 0.5])


def test_ten_thousand_sites_one_of_one_class(spark):
    """Coefficients of 10,000 sites: nothing of a site comes to the driver."""
    df = noisy(spark, 400_000, 10_000).withColumn("y", F.when(F.col("site") == "s7", 1).otherwise(F.col("y")))
    fits = silo.fit_lr_by_silo(df, FEATS, "y", "site", balanced=False)
    states = {r.state: r["count"] for r in fits.groupBy("state").count().collect()}
    assert sum(states.values()) == 10_000 and states["done"] > 9_900 and states["one class"] >= 1
    assert fits.where("site = 's7'").first().state == "one class"
    some = fits.where("state = 'done'").orderBy("site").first()
    coef, b = newton_lr(df.where(F.col("site") == some.site), FEATS, "y")[None]
    assert np.allclose(some.beta, [*coef, b], atol=1e-7)


def test_rows_are_not_shuffled_by_site(spark):
    """The only Exchange of a step is that of the sums."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = sitefit._base(noisy(spark, 100, 4), FEATS, "y", "site", None)
        first = sitefit.small_table(sitefit._solved(sitefit._sums(base, None, "site", 4), "site", 4, 1.0, 1e-9, True))
        step = sitefit._sums(base, first.where("state = 'open'"), "site", 4)
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_rows_are_not_sorted_by_site(spark):
    """Sums of a step are aggregated by hash; an array among them would sort the rows."""
    base = sitefit._base(noisy(spark, 100, 4), FEATS, "y", "site", None)
    first = sitefit.small_table(sitefit._solved(sitefit._sums(base, None, "site", 4), "site", 4, 1.0, 1e-9, True))
    for beta in (None, first):
        plan = sitefit._sums(base, beta, "site", 4)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
