"""Model queries: every run of the published grids, all of a family in the same jobs.

Two cohorts:

* documents ⋈ labels, target ``toxic`` (a rare outcome), features from the
  whole text (length, upper-case share, digit share) and the language code;
* labelled orders with a derived target (price plus a hash-seeded jitter).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from privtab.functions.exprs import round_fixed
from privtab.functions.hashing import hash_hex, hash_unit
from privtab.operators import anonymity as K
from privtab.operators import dp as D
from privtab.operators import masked as MK
from privtab.operators import forest as FO
from privtab.operators import metrics as M
from privtab.operators import report as R
from privtab.operators import silo as V
from privtab.operators import sitefit as S
from privtab.operators.encode import balanced_weights, label_encode, minmax_by, minmax_scale
from privtab.operators.logreg import newton_lr, predict_grouped
from privtab.operators.sampling import assign_silo, stratified_split, with_seeds
from privtab.plans import modelsql
from privtab.plans.kanon import orders_qi
from privtab.plans.sqlparts import K_VALUES, SEEDS
from privtab.session import materialize, small_table, spread
from privtab.sources import load

DOC_FEATS = ["len_s", "upper_s", "digit_s", "lang_s"]
ORD_FEATS = ["price_s", "prio_s", "month_s"]
KEYS = ["seed", "model", "setting"]


def doc_cohort(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = load(spark, sf, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id")
    n = F.greatest(F.length("text"), F.lit(1)).cast("double")
    j = j.select(
        "doc_id", F.col("toxic").cast("int").alias("target"),
        F.log1p(F.col("n_chars").cast("double")).alias("len_s"),
        (F.length(F.regexp_replace("text", "[^A-Z]", "")) / n).alias("upper_s"),
        (F.length(F.regexp_replace("text", "[^0-9]", "")) / n).alias("digit_s"),
        F.col("lang").alias("lang_s"))
    j = label_encode(j, ["lang_s"])
    return minmax_scale(j, DOC_FEATS)


def order_cohort(spark, sf):
    o = orders_qi(spark, sf).select("o_orderkey", "o_orderpriority", "o_year", "o_month",
                                    "o_totalprice")
    o = o.withColumn("price_s", F.col("o_totalprice")) \
         .withColumn("prio_s", F.substring("o_orderpriority", 1, 1).cast("double")) \
         .withColumn("month_s", F.col("o_month").cast("double"))
    o = minmax_scale(o, ORD_FEATS)
    jitter = hash_unit(hash_hex(99, "o_orderkey")) - F.lit(0.5)
    return o.withColumn("target", F.when(F.col("price_s") + F.lit(0.4) * jitter > 0.55, 1)
                        .otherwise(0))


def _split(df, seed, key):
    """Seeded split, materialised: many fits and evaluations read it."""
    return materialize(stratified_split(df, "target", 0.2, seed, key))


def _preds(df, model, setting):
    """Run rows: seed, model, setting, actual, predicted."""
    return df.select("seed", F.lit(model).alias("model") if isinstance(model, str) else model.alias("model"),
                     F.lit(setting).alias("setting") if isinstance(setting, str) else setting.alias("setting"),
                     F.col("target").alias("actual"), "predicted")


def lr_utility(spark, sf, seed=42):
    """L1 + L3 + A12 on the document cohort: the plain and the class-balanced
    model are two groups of ONE Newton fit of the L1 objective (rows repeated
    per variant, weight 1 or n/(2 n_c))."""
    sp = _split(doc_cohort(spark, sf), seed, "doc_id")
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    variants = F.explode(F.array(F.lit("Baseline (No Privacy)"), F.lit("Baseline (balanced)")))
    x = balanced_weights(train, "target").withColumn("setting", variants)
    x = x.withColumn("weight", F.when(F.col("setting") == "Baseline (balanced)", F.col("weight"))
                     .otherwise(F.lit(1.0)))
    fits = newton_lr(x, DOC_FEATS, "target", weight="weight", group="setting")
    pred = predict_grouped(test.withColumn("setting", variants), fits, DOC_FEATS, "setting")
    p = pred.select(F.lit(seed).alias("seed"), F.lit("Logistic Regression").alias("model"),
                    "setting", F.col("target").alias("actual"), "predicted")
    return M.evaluate(p, KEYS)


# Fixed value: trees of the published forests.
TREES = 100
SETTINGS = ("Baseline (No Privacy)", "Baseline (balanced)")


def rf_utility(spark, sf, seeds=SEEDS):
    """L2 + L3 + A12 on the document cohort: a plain and a balanced forest of
    100 trees per seed, as groups of one grouped forest."""
    sp = materialize(stratified_split(with_seeds(doc_cohort(spark, sf), seeds), "target", 0.2,
                                      F.col("seed"), "doc_id", by=["seed"]))
    variant = F.explode(F.array(*[F.lit(x) for x in SETTINGS]))
    sp = (sp.withColumn("setting", variant).withColumn("trees", F.lit(TREES))
          .withColumn("grp", F.concat_ws(":", "seed", "setting")))
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    votes = FO.forest_votes(train, test, DOC_FEATS, "target", "doc_id", "grp", F.col("setting") == SETTINGS[1])
    pred = FO.label_rows(test, votes, DOC_FEATS, ["grp"], F.col("trees"))
    return M.evaluate(_preds(pred, "Random Forest", F.col("setting")), KEYS)


K_QIS = ["o_orderpriority", "o_year", "o_month"]
K_STATS = ["train_rows_used", "rows_suppressed", "suppression_rate", "classes_before",
           "classes_after", "min_class_size"]


def k_utility(spark, sf, ks=K_VALUES, seeds=SEEDS):
    """Every k and seed in one set of jobs.  Rows of a seed's train set are
    repeated per k where their class has at least k rows (K2 via W1), rescaled
    per (seed, k) on the kept rows (E3), weighted (E6) and fitted as groups of
    ONE Newton run (balanced L2 LR, the L1 objective) and of ONE grouped forest
    (L2, balanced, 100 trees); the seed's test rows are scored by the model of
    their (seed, k).  k = 1 is the baseline (K8 statistics).  Skipped runs (K9)
    carry NULL metrics.

    A larger k keeps some of the rows of a smaller one, so those of a seed that
    keep equally many rows keep the same: they are one fit, scored once, and
    each k has its metrics."""
    sp = _seeded_split(order_cohort(spark, sf).select("o_orderkey", *K_QIS, *ORD_FEATS, "target"), seeds)
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    stats = K.skip_reason(K.k_sweep(train, K_QIS, [1, *ks], by=["seed"], target="target"))
    stats = small_table(stats.select("seed", "k", *K_STATS, "skipped_reason"), "k-stats")
    alike = Window.partitionBy("seed", "train_rows_used")
    shared = stats.where("skipped_reason = ''").select("seed", "k", F.min("k").over(alike).alias("fit"))
    shared = small_table(shared, "k-fits")
    runs = shared.where("k = fit").select("seed", "k")
    cols = ["seed", "o_orderkey", *ORD_FEATS, "target", "is_test"]
    sized = materialize(K.with_class_size(train, K_QIS, by=["seed"]).select(*cols, "class_size"))
    raw = sized.join(runs, "seed").where((F.col("k") <= 1) | (F.col("class_size") >= F.col("k"))).select(*cols, "k")
    both = raw.unionByName(test.select(*cols).join(runs, "seed"))
    scaled = materialize(minmax_by(both, ORD_FEATS, ["seed", "k"], fit_on=raw))
    scaled = scaled.withColumns({"grp": F.concat_ws(":", "seed", "k"), "trees": F.lit(TREES)})
    kept = balanced_weights(scaled.where(~F.col("is_test")), "target", by=["seed", "k"])
    tests = scaled.where(F.col("is_test"))
    fits = newton_lr(kept, ORD_FEATS, "target", weight="weight", group="grp", persist=False)  # stored rows
    lr = predict_grouped(tests, fits, ORD_FEATS, "grp").withColumn("family", F.lit("Logistic Regression"))
    votes = FO.forest_votes(kept, tests, ORD_FEATS, "target", "o_orderkey", "grp")
    rf = FO.label_rows(tests, votes, ORD_FEATS, ["grp"], F.col("trees")).withColumn("family", F.lit("Random Forest"))
    cols = ["seed", F.col("k").alias("fit"), "family", F.col("target").alias("actual"), "predicted"]
    metrics = M.evaluate(lr.select(*cols).unionByName(rf.select(*cols)), ["seed", "fit", "family"])
    families = F.explode(F.array(F.lit("Logistic Regression"), F.lit("Random Forest")))
    name = F.when(F.col("k") == 1, F.col("family")).otherwise(F.concat(F.lit("K-anonymised "), "family"))
    setting = F.when(F.col("k") == 1, F.lit(SETTINGS[0])).otherwise(F.concat(F.lit("K-anonymity k="), F.col("k").cast("string")))
    return (stats.join(shared, ["seed", "k"], "left").withColumn("family", families)
            .join(metrics, ["seed", "fit", "family"], "left")
            .select("seed", name.alias("model"), setting.alias("setting"), *K_STATS, "skipped_reason", *M.METRICS))


def _hidden_runs(spark, sf, seeds):
    """M2 test labels of every seed's fitted model (L1): plain scoring and
    secret-shared scoring, in its production form (masks under a secret salt
    from the operating system)."""
    sp = materialize(stratified_split(with_seeds(doc_cohort(spark, sf), seeds), "target", 0.2,
                                      F.col("seed"), "doc_id", by=["seed"]))
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    fits = newton_lr(train, DOC_FEATS, "target", group="seed")
    runs = [predict_grouped(test, fits, DOC_FEATS, "seed").select(
        "seed", F.lit("Normal Logistic Regression").alias("model"), F.lit("Baseline").alias("setting"),
        F.col("target").alias("actual"), "predicted")]
    for s, (coef, b) in sorted(fits.items()):  # one pair of share tables per seed
        mine = test.where(F.col("seed") == s)
        w = dict(zip(DOC_FEATS, map(float, coef)))
        hid = MK.hidden_score(mine, DOC_FEATS, MK.weights_of(w, DOC_FEATS), b, "doc_id", seed=None)
        runs.append(hid.select("doc_id", F.col("label").alias("predicted"))
                    .join(mine.select("doc_id", F.col("target").alias("actual")), "doc_id")
                    .select(F.lit(s).alias("seed"),
                            F.lit("HE Logistic Regression Inference").alias("model"),
                            F.lit("Encrypted Inference").alias("setting"), "actual", "predicted"))
    return R.union_results(runs)


def hidden_utility(spark, sf, seeds=SEEDS):
    """M2 with fitted models: metrics of plain and hidden scoring per seed."""
    return M.evaluate(_hidden_runs(spark, sf, seeds), KEYS)


def hidden_confusion(spark, sf, seeds=SEEDS):
    """M2: confusion rows of plain and hidden scoring per seed."""
    return M.confusion(_hidden_runs(spark, sf, seeds), KEYS)


def _seeded_split(cohort, seeds):
    """One stored split for all seeds, of a cohort stored in even parts."""
    return materialize(stratified_split(with_seeds(materialize(spread(cohort)), seeds), "target", 0.2, F.col("seed"), "o_orderkey", by=["seed"]))


def _seeded(spark, sf, seeds):
    sp = _seeded_split(order_cohort(spark, sf).select("o_orderkey", *ORD_FEATS, "target"), seeds)
    return sp.where(~F.col("is_test")), sp.where(F.col("is_test"))


def _sites(train, settings):
    """Train rows once per site setting, with their site (unique names), stored."""
    x = train.withColumn("n_sites", F.explode(F.array(*[F.lit(p) for p, _ in settings])))
    x = assign_silo(x, F.col("n_sites"), F.col("seed"), "o_orderkey", by=["seed", "n_sites"])
    return materialize(x.withColumn("site", F.concat_ws(":", "seed", "n_sites", "silo")))


# The published federation settings (sites, rounds).
FL_SETTINGS = ((3, 10), (5, 20), (10, 20))


def silo_lr(spark, sf, settings=FL_SETTINGS, seeds=SEEDS):
    """V2: balanced LR coefficients of every site of every setting and seed
    (one Newton job per step for all)."""
    train, _ = _seeded(spark, sf, seeds)
    fits = _named(V.fit_lr_by_silo(_sites(train, settings), ORD_FEATS, "target", silo="site"))
    names = F.array(*[F.lit(c) for c in [*ORD_FEATS, "intercept"]])
    each = fits.select("seed", "n_sites", "silo", F.posexplode("beta"))
    return each.select("seed", "n_sites", "silo", names[F.col("pos")].alias("feature"), round_fixed("col", 6).alias("coef"))


def _named(fits):
    """Site models with the parts of their site's name."""
    parts = F.split("site", ":")
    return fits.select(*[parts[i].cast("int").alias(c) for i, c in enumerate(("seed", "n_sites", "silo"))], "beta")


# Fixed value: trees of a site's forest in one published round.
ROUND_TREES = 20
#: Bins of a feature in the federated forests: 33,000 trees share the cells.
FL_BINS = 8


def _fl_setting(p, r):
    return f"FL ({p} clients, {r} rounds)"


def _fl_rows(test, settings):
    """Test rows once per site setting, with their federation and its name."""
    fl = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(_fl_setting(p, r)).alias("setting")) for p, r in settings]))
    t = test.withColumn("_fl", fl).select("*", "_fl.setting", F.col("_fl.p").alias("n_sites")).drop("_fl")
    return t.withColumn("fed", F.format_string("%d:%d", "seed", "n_sites"))


def _fl_forest_runs(sites, test, settings):
    """V3 + V4 test labels: the rounds of a site are bagging groups of its forest."""
    rounds = F.create_map(*[F.lit(v) for p, r in settings for v in (p, r * ROUND_TREES)])
    x = sites.withColumn("fed", F.format_string("%d:%d", "seed", "n_sites"))
    pred = V.rf_by_silo(x, _fl_rows(test, settings), ORD_FEATS, "target", "o_orderkey", "fed", rounds[F.col("n_sites")],
                        silo="site", bins=FL_BINS)
    return _preds(pred, "Federated Random Forest", F.col("setting"))


def silo_rf(spark, sf, settings=FL_SETTINGS, seeds=SEEDS):
    """V3 + V4: balanced forests of every site, setting and seed (20 trees a
    round) in one grouped forest, probabilities averaged over sites."""
    train, test = _seeded(spark, sf, seeds)
    return M.evaluate(_fl_forest_runs(_sites(train, settings), test, settings), KEYS)


def fed_avg(spark, sf, settings=FL_SETTINGS, seeds=SEEDS):
    """V5: weighted parameter averaging over rounds, then scoring; every
    (seed, setting) is a federation of the same jobs."""
    train, test = _seeded(spark, sf, seeds)
    x = _sites(train, settings).withColumn("fed", F.format_string("%d:%d", "seed", "n_sites"))
    rounds = {f"{s}:{p}": r for s in seeds for p, r in settings}
    fits = V.fed_avg_table(x, ORD_FEATS, "target", "fed", rounds, silo="site")
    pred = S.label_by_table(_fl_rows(test, settings), fits, ORD_FEATS, "fed")
    return M.evaluate(_preds(pred, "FedAvg Logistic Regression", F.col("setting")), KEYS)


def silo_utility(spark, sf, settings=FL_SETTINGS, seeds=SEEDS):
    """V6: the balanced LR baseline and every site of every setting and seed
    are groups of ONE Newton fit (rows repeated per setting by a generator),
    and of ONE grouped forest; each setting's sites are then averaged (V4) and
    evaluated.  For LR ``rounds`` only names the setting: a refitted site model
    is the same model; a site's forest has 20 trees a round."""
    train, test = _seeded(spark, sf, seeds)
    x = _sites(train, settings)
    base = train.withColumn("site", F.format_string("%d:0:0", "seed"))
    fits = _named(V.fit_lr_by_silo(x.select(*base.columns).unionByName(base), ORD_FEATS, "target", silo="site"))
    alone = S.label_by_table(test, fits.where("n_sites = 0"), ORD_FEATS, "seed")
    models = fits.where("n_sites > 0").withColumn("fed", F.format_string("%d:%d", "seed", "n_sites"))
    joint = S.label_by_sites(_fl_rows(test, settings), models, ORD_FEATS, "fed", "silo")
    runs = [_preds(alone, "Logistic Regression", SETTINGS[0]),
            _preds(joint, "Federated Logistic Regression", F.col("setting"))]
    runs += [_baseline_forest(train, test, True), _fl_forest_runs(x, test, settings)]
    return M.evaluate(R.union_results(runs), KEYS)


def _baseline_forest(train, test, balanced):
    """L2 test labels: a forest of 100 trees per seed."""
    votes = FO.forest_votes(*[x.withColumn("trees", F.lit(TREES)).withColumn("grp", F.col("seed")) for x in (train, test)],
                            ORD_FEATS, "target", "o_orderkey", "grp", balanced)
    pred = FO.label_rows(test.withColumn("grp", F.col("seed")), votes, ORD_FEATS, ["grp"], F.lit(TREES))
    return _preds(pred, "Random Forest", SETTINGS[0])


# The published privacy budgets.
EPSILONS = (10.0, 5.0, 1.0, 0.5, 0.1)


# Declared bounds of the order features: known without looking at the data.
ORD_BOUNDS = {"o_totalprice": (0.0, 600_000.0), "prio": (1.0, 5.0), "o_month": (1.0, 12.0)}
DP_FEATS = [f"{c}_d" for c in ORD_BOUNDS]
DP_DEPTH = 5


def _dp_seeded(spark, sf, seeds):
    """Train and test rows with features scaled by declared bounds; the plain
    baselines keep the learned scaling."""
    cohort = order_cohort(spark, sf).withColumn("prio", F.substring("o_orderpriority", 1, 1).cast("double"))
    declared = D.declare(cohort, ORD_BOUNDS, "_d")
    sp = D.Bounded(_seeded_split(declared.rows, seeds), declared.features, declared.declared)
    return sp.where(~F.col("is_test")), sp.where(F.col("is_test"))


def _dp_lr_runs(train, test, seeds, epsilons):
    """D1 test labels: every (seed, ε) objective-perturbation fit is a group
    of one Newton run."""
    clipped, names = D.clip_rows(train.private_rows(), DP_FEATS)
    n_by_seed = {r["seed"]: r["count"] for r in clipped.groupBy("seed").count().collect()}
    terms = {f"{s}:{i}": (n_by_seed[s], *D.perturbation_terms(e, n_by_seed[s], len(names), s * 1000 + i))
             for s in seeds for i, e in enumerate(epsilons)}
    eps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"DP e={e}").alias("setting"))
                              for i, e in enumerate(epsilons)]))

    def grouped(df):
        return df.withColumn("_e", eps).withColumn("grp", F.format_string("%d:%d", "seed", "_e.i"))

    fits = newton_lr(grouped(clipped), names, "target", group="grp", fit_intercept=False,
                     l2={k: 1.0 + n * delta for k, (n, _, delta) in terms.items()},
                     linear_term={k: b for k, (_, b, _) in terms.items()})
    # clipped rows are positive multiples of [x, 1]: same sign, so score raw rows
    models = {k: (c[:len(DP_FEATS)], float(c[len(DP_FEATS)])) for k, (c, _) in fits.items()}
    return _preds(predict_grouped(grouped(test.rows), models, DP_FEATS, "grp"), "DP Logistic Regression", F.col("_e.setting"))


def dp_lr(spark, sf, epsilons=EPSILONS, seeds=SEEDS):
    """Objective-perturbation LR, all seeds and ε in one Newton run."""
    return M.evaluate(_dp_lr_runs(*_dp_seeded(spark, sf, seeds), seeds, epsilons), KEYS)


def _dp_forest_runs(train, test, seeds, epsilons):
    """D2 test labels: 100 data-independent trees per seed, leaves counted once
    for all ε, all ε scored in one pass."""
    model = D.fit_dp_forest(train, "target", "o_orderkey", epsilons, TREES, DP_DEPTH, 7, seeds, "seed")
    pred = D.predict_dp_forest(test.rows.select("seed", "target", *DP_FEATS), model)
    return _preds(pred, "DP Random Forest", F.concat(F.lit("DP e="), F.col("epsilon").cast("string")))


def dp_forest(spark, sf, epsilons=EPSILONS, seeds=SEEDS):
    """Data-independent forests with ε-DP leaf labels, all seeds and ε."""
    return M.evaluate(_dp_forest_runs(*_dp_seeded(spark, sf, seeds), seeds, epsilons), KEYS)


def dp_utility(spark, sf, seeds=SEEDS, epsilons=EPSILONS):
    """D3: ε sweep x seeds x two models with plain baselines, summarised (A1).

    One split for all seeds (X1); every (seed, ε) objective-perturbation fit
    is a group of one Newton run, the per-seed LR baselines are groups of a
    second, the per-seed plain forests (100 trees) groups of one grouped
    forest, and the DP forests share their leaf counts over ε."""
    train, test = _dp_seeded(spark, sf, seeds)
    base = newton_lr(train.rows, ORD_FEATS, "target", group="seed")
    runs = [_dp_lr_runs(train, test, seeds, epsilons), _dp_forest_runs(train, test, seeds, epsilons),
            _preds(predict_grouped(test.rows, base, ORD_FEATS, "seed"), "Logistic Regression", SETTINGS[0]),
            _baseline_forest(train.rows, test.rows, False)]
    return R.summarise(M.evaluate(R.union_results(runs), KEYS), ["model", "setting"], M.METRICS)


QUERIES = {
    "lr_utility": lr_utility,
    "rf_utility": rf_utility,
    "k_utility": k_utility,
    "hidden_utility": hidden_utility,
    "hidden_confusion": hidden_confusion,
    "silo_lr": silo_lr,
    "silo_rf": silo_rf,
    "fed_avg": fed_avg,
    "silo_utility": silo_utility,
    "dp_lr": dp_lr,
    "dp_forest": dp_forest,
    "dp_utility": dp_utility,
}

_DP = (EPSILONS, ORD_FEATS, ORD_BOUNDS, DP_FEATS)

ORACLES = {
    "lr_utility": modelsql.lr_utility(),
    "rf_utility": modelsql.rf_utility(TREES, SETTINGS),
    "k_utility": modelsql.k_utility(ORD_FEATS, K_QIS, TREES),
    "hidden_utility": modelsql.hidden_utility(),
    "hidden_confusion": modelsql.hidden_confusion(),
    "silo_lr": modelsql.silo_lr(FL_SETTINGS, ORD_FEATS),
    "silo_rf": modelsql.silo_rf(FL_SETTINGS, ORD_FEATS, ROUND_TREES, FL_BINS),
    "silo_utility": modelsql.silo_utility(FL_SETTINGS, ORD_FEATS, TREES, ROUND_TREES, FL_BINS),
    "fed_avg": modelsql.fed_avg(FL_SETTINGS, ORD_FEATS),
    "dp_lr": modelsql.dp_lr(*_DP),
    "dp_forest": modelsql.dp_forest(*_DP, TREES, DP_DEPTH, 7),
    "dp_utility": modelsql.dp_utility(*_DP, TREES, DP_DEPTH, 7),
}
