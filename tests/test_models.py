import numpy as np
import pytest
from pyspark.sql import functions as F

from privtab.operators import dp as D
from privtab.operators import masked as MK
from privtab.operators import ml
from privtab.operators.logreg import newton_lr, predict_grouped
from privtab.operators.silo import ensemble_by_silo, fed_avg, fed_avg_many
from privtab.plans import models


UNIT = {c: (0.0, 1.0) for c in "abc"}


def _data(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(size=(n, 3))
    logit = 3 * x[:, 0] - 2 * x[:, 1] + 0.5
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, y int")


def test_newton_equals_spark_ml_lr(spark):
    df = _data(spark)
    coef, b = newton_lr(df, ["a", "b", "c"], "y")[None]
    m = ml.fit_lr(df, ["a", "b", "c"], "y")
    assert np.allclose(coef, m.coefficients.toArray(), atol=1e-4)
    assert b == pytest.approx(m.intercept, abs=1e-4)


def test_fed_avg_one_site_equals_l1(spark):
    df = _data(spark).withColumn("silo", F.lit(0))
    coef, b = fed_avg(df, ["a", "b", "c"], "y", rounds=8, balanced=False)
    ref, rb = newton_lr(df, ["a", "b", "c"], "y")[None]
    assert np.allclose(coef, ref, atol=1e-6) and b == pytest.approx(rb, abs=1e-6)


def test_shares_recombine_exactly(spark):
    df = _data(spark, 200)
    w = [1.5, -2.25, 0.125]
    hid = MK.hidden_score(df, ["a", "b", "c"], w, 0.3, "key").select("key", "score")
    plain = MK.plain_fixed_score(df, ["a", "b", "c"], w, 0.3, "key").select(
        "key", F.col("score").alias("plain"))
    j = hid.join(plain, "key")
    assert j.count() == 200 and j.where(F.col("score") != F.col("plain")).count() == 0


def test_share_tables_score_alike_again_and_again(spark):
    df = _data(spark, 300).unionByName(spark.createDataFrame([(1000, None, 1.0, 2.0, 0)], "key long, a double, b double, c double, y int"))
    cols, w = ["a", "b", "c"], [1.5, -2.25, 0.125]
    tables, plain = MK.share_tables(df, cols, "key", seed=3, buckets=5), MK.share(df, cols, "key", seed=3)
    for one, two in zip(tables, plain):
        assert one.columns == two.columns == ["key", "s_0", "s_1", "s_2"]
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select("key", *[F.col(c).cast("long") for c in two.columns[1:]]).collect()))
    for weights in (w, [0.5, 0.5, -4.0]):  # shared once, scored twice
        a, b = (MK.score_share(t, weights, "key") for t in tables)
        got = {r.key: r.score for r in MK.recombine(a, b, "key", 0.3).collect()}
        want = {r.key: r.score for r in MK.plain_fixed_score(df, cols, weights, 0.3, "key").collect()}
        assert got == want and got[1000] is None and len(got) == 301
    empty = MK.share_tables(df.where("key < 0"), cols, "key", buckets=2)
    assert MK.recombine(*(MK.score_share(t, w, "key") for t in empty), "key", 0.0).count() == 0
    secret, _ = MK.share_tables(df, cols, "key", buckets=2)
    assert secret.join(tables[0], ["key", "s_0"]).count() == 0
    assert MK.drop_shares(spark) >= 3 and MK.drop_shares(spark) == 0


def test_dp_lr_large_epsilon_close_to_noiseless(spark):
    df = _data(spark, 2000)
    model = D.fit_dp_lr(D.declare(df, UNIT), "y", epsilon=1e6, seed=1)
    clipped, names = D.clip_rows(df, ["a", "b", "c"])
    ref, _ = newton_lr(clipped, names, "y", fit_intercept=False)[None]
    assert np.allclose(model["coef"], ref, atol=1e-3)


def test_dp_lr_second_branch_small_epsilon(spark):
    b, delta = D.perturbation_terms(0.1, 1000, 4, seed=0)
    assert delta > 0
    b2, delta2 = D.perturbation_terms(1.0, 1000, 4, seed=0)
    assert delta2 == 0.0


def _leaf(row, feats, ths, depth):
    node = 0
    for _ in range(depth):
        v = row["abc"[feats[node]]]
        node = 2 * node + 1 + (v is not None and v > ths[node])
    return node - (2 ** depth - 1)


def test_dp_forest_large_epsilon_is_majority(spark):
    df = _data(spark, 800)
    feats, ths = D.random_trees(5, 2, 3, seed=3)
    counts = D.forest_leaf_counts(df, ["a", "b", "c"], "y", "key", {None: (feats, ths)}, 2)
    labels = D.label_arrays(D.noisy_leaf_labels(counts, 5, 2, [1e9], seed=0), 1, 5, 2)[None][0]
    table = {}
    for r in counts.collect():
        table.setdefault((r["tree"], r["leaf"]), {})[r["label"]] = r["n"]
    assert sum(sum(c.values()) for c in table.values()) == 800
    for (t, leaf), c in table.items():
        if c.get(0, 0) != c.get(1, 0):
            assert labels[t][leaf] == max(c, key=c.get)


def test_dp_forest_counts_and_votes_equal_a_plain_walk(spark):
    df = _data(spark, 300).withColumn("g", (F.col("key") % 2).cast("int"))
    df = df.withColumn("a", F.when(F.col("key") % 9 != 0, F.col("a")))  # a missing value goes left
    model = D.fit_dp_forest(D.declare(df, UNIT), "y", "key", [5.0, 0.1], n_trees=7, depth=3, seed=1, seeds=(0, 1), group="g")
    rows = D.declare(df, UNIT).rows.collect()
    got = {(r["key"], r["epsilon"]): (r["predicted"], r["p"])
           for r in D.predict_dp_forest(D.declare(df, UNIT).rows, model, prob="p").collect()}
    assert len(got) == 600
    for r in rows:
        feats, ths, labels = model["forests"][r["g"]]
        for i, e in enumerate((5.0, 0.1)):
            votes = sum(int(labels[i, t, _leaf(r, feats[t], ths[t], 3)]) for t in range(7))
            assert got[r["key"], e] == (int(votes / 7 >= 0.5), votes / 7)


def test_secret_noise_differs_and_keeps_majorities(spark):
    df = _data(spark, 400)
    trees = {None: D.random_trees(3, 2, 3, seed=3)}
    counts = D.forest_leaf_counts(df, ["a", "b", "c"], "y", "key", trees, 2)
    tables = [D.label_arrays(D.noisy_leaf_labels(counts, 3, 2, [0.001] * 40, seed=s), 40, 3, 2)[None] for s in (None, None, 5, 5)]
    assert (tables[0] != tables[1]).any() and (tables[2] == tables[3]).all()


def test_learned_bounds_are_refused(spark):
    df = _data(spark, 200)
    with pytest.raises(ValueError, match="learned bounds"):
        D.fit_dp_lr(D.learned(df, ["a", "b", "c"]), "y", epsilon=1.0, seed=1)
    with pytest.raises(ValueError, match="learned bounds"):
        D.fit_dp_forest(D.learned(df, ["a", "b", "c"]), "y", "key", [1.0], n_trees=2, depth=2, seed=1)
    assert D.fit_dp_lr(D.learned(df, ["a", "b", "c"]), "y", epsilon=1.0, seed=1, non_private=True)["n"] == 200
    with pytest.raises(ValueError, match="not below"):
        D.declare(df, {"a": (1.0, 1.0)})
    odd = spark.createDataFrame([(-5.0,), (3.0,), (None,), (float("nan"),), (0.5,)], "a double")
    assert [r.a for r in D.declare(odd, {"a": (0, 2)}).rows.collect()] == [0.0, 1.0, None, None, 0.25]


def test_grouped_fit_equals_separate_fits(spark):
    from privtab.operators.encode import minmax_by
    df = _data(spark, 900).withColumn("grp", (F.col("key") % 3).cast("int"))
    scaled = minmax_by(df, ["a", "b", "c"], ["grp"])
    fits = newton_lr(scaled, ["a", "b", "c"], "y", group="grp")
    for g in range(3):
        alone = newton_lr(scaled.where(F.col("grp") == g), ["a", "b", "c"], "y")[None]
        assert np.allclose(fits[g][0], alone[0], atol=1e-8) and fits[g][1] == pytest.approx(alone[1])
    mins = scaled.groupBy("grp").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).collect()
    assert all(r["lo"] == 0.0 and r["hi"] == 1.0 for r in mins)


def test_secret_salt_masks_recombine_exactly(spark):
    df = _data(spark, 150)
    w = [0.75, -1.5, 2.0]
    a, b = MK.share(df, ["a", "b", "c"], "key", seed=None)
    hid = MK.recombine(MK.score_share(a, w, "key"), MK.score_share(b, w, "key"), "key", -0.2)
    plain = MK.plain_fixed_score(df, ["a", "b", "c"], w, -0.2, "key").select(
        "key", F.col("score").alias("plain"))
    j = hid.select("key", "score").join(plain, "key")
    assert j.count() == 150 and j.where(F.col("score") != F.col("plain")).count() == 0
    seeded, _ = MK.share(df, ["a", "b", "c"], "key", seed=0)
    same = a.alias("x").join(seeded.alias("y"), "key").where(F.col("x.s_0") == F.col("y.s_0"))
    assert same.count() == 0  # salted masks are not the replayable ones


def test_site_forests_vote_together_and_dp_forest_predicts(spark):
    from privtab.operators import forest as FO
    from privtab.operators.silo import rf_by_silo
    df = _data(spark, 600).withColumn("silo", (F.col("key") % 2).cast("int")).withColumn("fed", F.lit("f"))
    feats = ["a", "b", "c"]
    pred = rf_by_silo(df.withColumn("seed", F.lit(1)), df, feats, "y", "key", "fed", 6).collect()
    assert len(pred) == 600
    x = df.withColumns({"seed": F.lit(1), "trees": F.lit(6)})
    asked = x.drop("silo").withColumn("silo", F.explode(F.array(F.lit(0), F.lit(1))))
    votes = {}
    for r in FO.forest_votes(x, asked, feats, "y", "key", "silo").collect():
        votes[tuple(r.bins)] = votes.get(tuple(r.bins), 0) + r.votes
    cell = {r.key: tuple(r.b) for r in df.select("key", FO.bins_of(feats).alias("b")).collect()}
    assert all(r["predicted"] == int(votes[cell[r["key"]]] * 2 >= 12 * FO.UNIT) for r in pred)
    bounded = D.declare(df, UNIT)
    forest = D.fit_dp_forest(bounded, "y", "key", [1e9], n_trees=4, depth=2, seed=5)
    scored = D.predict_dp_forest(bounded.rows, forest, prob="votes").collect()
    assert {r["predicted"] for r in scored} <= {0, 1}
    assert all(r["votes"] in (0.0, 0.25, 0.5, 0.75, 1.0) for r in scored)


def test_scores_out_of_range_are_refused(spark):
    df = spark.createDataFrame([(1, 5e5), (2, 1.0)], "key int, a double")
    with pytest.raises(Exception, match="out of range"):
        MK.hidden_score(df, ["a"], [2.5], 0.0, "key").collect()
    assert MK.hidden_score(df.where("key = 2"), ["a"], [2.5], 0.0, "key").first()["score"] == 2.5


def test_null_feature_and_unknown_group_have_no_label(spark):
    from privtab.operators.logreg import predict_grouped
    df = spark.createDataFrame([(1, None)], "key int, a double")
    assert MK.hidden_score(df, ["a"], [1.0], 0.0, "key").first()["label"] is None
    rows = spark.createDataFrame([("g", 1.0), ("h", 1.0)], "grp string, a double")
    got = {r.grp: r.predicted for r in predict_grouped(rows, {"g": ([1.0], 0.0)}, ["a"], "grp").collect()}
    assert got == {"g": 1, "h": None}


def test_fit_that_does_not_converge_raises(spark):
    df = _data(spark)
    with pytest.raises(RuntimeError, match="no convergence"):
        newton_lr(df, ["a", "b", "c"], "y", max_iter=2)


def test_many_groups_equal_single_fits_and_unknown_group_is_null(spark):
    df = _data(spark).withColumn("site", (F.col("key") % 15).cast("int"))
    fits = newton_lr(df, ["a", "b", "c"], "y", group="site")
    assert len(fits) == 15
    for g in (0, 14):
        coef, b = newton_lr(df.where(F.col("site") == g), ["a", "b", "c"], "y")[None]
        assert np.allclose(fits[g][0], coef, atol=1e-8) and fits[g][1] == pytest.approx(b, abs=1e-8)
    odd = df.limit(1).withColumn("site", F.lit(99))
    assert predict_grouped(odd, fits, ["a", "b", "c"], "site").first()["predicted"] is None


def test_ensemble_is_the_mean_of_site_probabilities(spark):
    df = _data(spark, 20)
    models = {0: (np.array([1.0, -2.0, 0.5]), 0.1), 1: (np.array([0.0, 3.0, -1.0]), -0.4)}
    got = ensemble_by_silo(df, models, ["a", "b", "c"]).collect()
    for r in got:
        x = np.array([r["a"], r["b"], r["c"]])
        want = np.mean([1 / (1 + np.exp(-(c @ x + b))) for c, b in models.values()])
        assert r["prob"] == pytest.approx(want) and r["predicted"] == int(want >= 0.5)


def test_federations_do_not_mix(spark):
    df = _data(spark).withColumn("fed", F.when(F.col("key") < 200, "p").otherwise("q"))
    df = df.withColumn("silo", F.concat("fed", (F.col("key") % 2).cast("string")))
    both = fed_avg_many(df, ["a", "b", "c"], "y", "fed", {"p": 2, "q": 4})
    for name, rounds in (("p", 2), ("q", 4)):
        coef, b = fed_avg(df.where(F.col("fed") == name), ["a", "b", "c"], "y", rounds=rounds)
        assert np.allclose(both[name][0], coef) and both[name][1] == pytest.approx(b)


def _few_orders(spark, folder):
    """60 orders in three classes of 26, 30 and 4 rows."""
    day = F.when(F.col("id") < 26, "1995-03-04").when(F.col("id") < 56, "1996-07-08").otherwise("1997-01-02")
    price = (F.col("id") * 7919 % 60) * 1000.0
    spark.range(60).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), price.alias("o_totalprice"),
        day.cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_k_that_keep_the_same_rows_are_one_fit(spark, tmp_path, monkeypatch):
    seen = []

    def newton(df, *args, **kwargs):
        seen.extend(r.grp for r in df.select("grp").distinct().collect())
        return newton_lr(df, *args, **kwargs)

    monkeypatch.setattr(models, "newton_lr", newton)
    got = {(r.setting, r.model): r for r in models.k_utility(spark, _few_orders(spark, tmp_path), ks=(2, 10, 500), seeds=(7,)).collect()}
    assert sorted(seen) == ["7:1", "7:10"] and len(got) == 8
    for family in ("Logistic Regression", "Random Forest"):
        base, two = got["Baseline (No Privacy)", family], got["K-anonymity k=2", f"K-anonymised {family}"]
        assert base.train_rows_used == two.train_rows_used == 48
        assert base.accuracy is not None and base[-4:] == two[-4:]
        assert got["K-anonymity k=10", f"K-anonymised {family}"].train_rows_used < 48
        assert got["K-anonymity k=10", f"K-anonymised {family}"].accuracy is not None
        assert got["K-anonymity k=500", f"K-anonymised {family}"].accuracy is None


def test_sites_hold_only_the_columns_of_a_fit(spark, tmp_path):
    train, test = models._seeded(spark, _few_orders(spark, tmp_path), (7,))
    assert train.columns == test.columns == ["o_orderkey", *models.ORD_FEATS, "target", "seed", "is_test"]
    assert train.count() + test.count() == 60 and len(train.inputFiles()) > 1
    sites = models._sites(train, ((2, 1), (3, 1)))
    assert "Window" not in sites._jdf.queryExecution().executedPlan().toString()  # stored
    assert sorted(r.site for r in sites.select("site").distinct().collect()) == ["7:2:0", "7:2:1", "7:3:0", "7:3:1", "7:3:2"]
