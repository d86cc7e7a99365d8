"""Evaluation and report queries.

Runs are the test rows of five seeded splits of the labelled orders, each
scored by a grid of fixed threshold rules named like the published study's
models and settings.  Every report table below is derived from them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from privtab.functions import labels as L
from privtab.operators import metrics as M
from privtab.operators import report as R
from privtab.plans.kanon import _SPLIT, seeded_split
from privtab.plans.sqlparts import rnd

# Scoring grid: (model, setting, price threshold); a row is predicted
# positive when o_totalprice exceeds the threshold.
GRID = [
    ("Logistic Regression", "Baseline (No Privacy)", 150000.0),
    ("Random Forest", "Baseline (No Privacy)", 200000.0),
    ("DP Logistic Regression", "DP e=10.0", 160000.0),
    ("DP Logistic Regression", "DP e=1.0", 250000.0),
    ("DP Random Forest", "DP e=0.5", 300000.0),
    ("Federated Logistic Regression", "FL (3 clients, 10 rounds)", 180000.0),
    ("Federated Random Forest", "FL (5 clients, 20 rounds)", 220000.0),
    ("K-anonymised Logistic Regression", "K-anonymity k=10", 170000.0),
    ("K-anonymised Random Forest", "K-anonymity k=100", 1.0e9),
    ("HE Logistic Regression Inference", "Encrypted Inference", 150000.0),
    ("Normal Logistic Regression", "Baseline", 150000.0),
]
KEYS = ["seed", "model", "setting"]


def scored_runs(spark, sf):
    test = seeded_split(spark, sf).where(F.col("is_test"))
    grid = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("setting"),
                              F.lit(t).alias("thr")) for m, s, t in GRID])
    x = test.select("seed", "o_orderkey", "o_totalprice", F.col("target").alias("actual"),
                    F.explode(grid).alias("_g"))
    return x.select("seed", "_g.model", "_g.setting", "actual",
                    F.when(F.col("o_totalprice") > F.col("_g.thr"), 1).otherwise(0)
                     .alias("predicted"))


def confusion_long(spark, sf):
    return M.confusion(scored_runs(spark, sf), KEYS)


def confusion_seed42(spark, sf):
    """Confusion rows of one seed."""
    return confusion_long(spark, sf).where(F.col("seed") == 42)


def metrics_by_run(spark, sf):
    return M.evaluate(scored_runs(spark, sf), KEYS)


def metrics_from_confusion(spark, sf):
    """A11 -> A12 (the same numbers as metrics_by_run)."""
    return M.metrics_from_confusion(confusion_long(spark, sf), KEYS)


def summary_mean_std(spark, sf):
    return R.summarise(metrics_by_run(spark, sf), ["model", "setting"], M.METRICS, digits=10)


def summary_rounded(spark, sf):
    return R.summarise(metrics_by_run(spark, sf), ["model", "setting"], M.METRICS, digits=4)


def main_results(spark, sf):
    return R.main_results(summary_mean_std(spark, sf), ["model", "setting"], M.METRICS)


def display_table(spark, sf):
    return R.display_table(summary_rounded(spark, sf), ["model", "setting"], M.METRICS)


def filled_summary(spark, sf):
    """mean and std columns filled from the display table's texts."""
    return R.fill_mean_std(display_table(spark, sf), [*M.METRICS, "runtime"])


def labels_and_order(spark, sf):
    """F1-F5, F7, F9, F10, W3-W6 over the display table."""
    d = display_table(spark, sf)
    return d.select(
        "model", "setting",
        L.short_model("model").alias("model_short"),
        L.short_setting("setting").alias("setting_short"),
        L.combined_label("model", "setting").alias("label"),
        L.epsilon_of("setting").alias("epsilon"),
        L.k_of("setting").alias("k"),
        L.mean_of("accuracy").alias("accuracy_mean"),
        L.std_of("accuracy").alias("accuracy_std"),
        L.setting_from_model("model").alias("he_setting"),
        R.is_baseline("setting").alias("is_baseline"),
        *[o.alias(f"dp_{i}") for i, o in enumerate(R.dp_order("model", "setting"))],
        *[o.alias(f"fl_{i}") for i, o in enumerate(R.fl_order("model", "setting"))],
        *[o.alias(f"k_{i}") for i, o in enumerate(R.k_order("model", "setting"))],
        *[o.alias(f"he_{i}") for i, o in enumerate(R.he_order("model", "setting"))])


def tradeoff_table(spark, sf):
    """J2 + X3: privacy rows next to the baseline of their own technique and
    model family.  The plain baselines serve DP, FL and k-anonymity; hidden
    scoring has a baseline of its own."""
    runs = metrics_by_run(spark, sf).withColumn("technique", F.explode(R.techniques("model")))
    keys = ["technique", "model", "setting"]
    summary = R.summarise(runs, keys, ["accuracy", "f1"], digits=10)
    summary = summary.withColumn("accuracy_std", F.coalesce("accuracy_std", F.lit(0.0))) \
                     .withColumn("f1_std", F.coalesce("f1_std", F.lit(0.0)))
    return R.with_baseline(summary, "model", "setting", ["accuracy_mean", "f1_mean"], by=["technique"])


QUERIES = {
    "confusion_long": confusion_long,
    "confusion_seed42": confusion_seed42,
    "metrics_by_run": metrics_by_run,
    "metrics_from_confusion": metrics_from_confusion,
    "summary_mean_std": summary_mean_std,
    "summary_rounded": summary_rounded,
    "main_results": main_results,
    "display_table": display_table,
    "filled_summary": filled_summary,
    "labels_and_order": labels_and_order,
    "tradeoff_table": tradeoff_table,
}

_GRID_SQL = "(VALUES " + ", ".join(
    f"('{m}', '{s}', CAST({t!r} AS DOUBLE))" for m, s, t in GRID) + ") g(model, setting, thr)"

_RUNS = f"""{_SPLIT},
runs AS (SELECT seed, model, setting, target AS actual,
                CASE WHEN o_totalprice > thr THEN 1 ELSE 0 END AS predicted
         FROM split CROSS JOIN {_GRID_SQL} WHERE is_test),
cells AS (SELECT seed, model, setting,
                 count(CASE WHEN actual = 0 AND predicted = 0 THEN 1 END) AS tn,
                 count(CASE WHEN actual = 0 AND predicted = 1 THEN 1 END) AS fp,
                 count(CASE WHEN actual = 1 AND predicted = 0 THEN 1 END) AS fn,
                 count(CASE WHEN actual = 1 AND predicted = 1 THEN 1 END) AS tp
          FROM runs GROUP BY ALL),
metrics AS (SELECT seed, model, setting,
   coalesce(CAST(tp + tn AS DOUBLE) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0.0) AS accuracy,
   coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
   coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
   coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall
   FROM cells)"""


def _summary_sql(digits: int, src: str = "metrics", metrics=M.METRICS) -> str:
    cols = ", ".join(f"{rnd(f'avg({m})', digits)} AS {m}_mean, "
                     f"{rnd(f'stddev_samp({m})', digits)} AS {m}_std" for m in metrics)
    return f"SELECT model, setting, {cols} FROM {src} GROUP BY model, setting"


_CONF = """SELECT seed, model, setting, 0 AS actual_class, tn AS predicted_0, fp AS predicted_1
FROM cells UNION ALL
SELECT seed, model, setting, 1, fn, tp FROM cells"""

_SHORT = "CASE " + " ".join(f"WHEN model = '{a}' THEN '{b}'" for a, b in
                            L.SHORT_MODEL_NAMES.items()) + " ELSE model END"
_SSET = r"""CASE WHEN contains(setting, 'Baseline') THEN 'Baseline'
     WHEN regexp_matches(setting, '(?i)k=(\d+)') THEN 'k=' || regexp_extract(setting, '(?i)k=(\d+)', 1)
     WHEN regexp_matches(setting, 'e=(\d+\.?\d*)') THEN 'ε=' || regexp_extract(setting, 'e=(\d+\.?\d*)', 1)
     WHEN regexp_matches(setting, 'FL \((\d+) clients, (\d+) rounds\)')
       THEN regexp_extract(setting, 'FL \((\d+) clients, (\d+) rounds\)', 1) || ' clients' || chr(10)
            || regexp_extract(setting, 'FL \((\d+) clients, (\d+) rounds\)', 2) || ' rounds'
     WHEN contains(setting, 'Encrypted Inference') THEN 'Encrypted'
     ELSE setting END"""
_EPS = r"TRY_CAST(regexp_extract(setting, 'e=(\d+\.?\d*)', 1) AS DOUBLE)"
_K = r"TRY_CAST(regexp_extract(setting, 'k=(\d+)', 1) AS INTEGER)"


def _text(m: str) -> str:
    return (f"CASE WHEN {m}_mean IS NULL THEN 'NA' ELSE printf('%.4f ± %.4f', {m}_mean, "
            f"coalesce({m}_std, 0.0)) END")


ORACLES = {
    "confusion_long": f"{_RUNS} {_CONF}",
    "confusion_seed42": f"{_RUNS} SELECT * FROM ({_CONF}) WHERE seed = 42",
    "metrics_by_run": f"{_RUNS} SELECT * FROM metrics",
    "metrics_from_confusion": f"{_RUNS} SELECT * FROM metrics",
    "summary_mean_std": f"{_RUNS} {_summary_sql(10)}",
    "summary_rounded": f"{_RUNS} {_summary_sql(4)}",
    "main_results": f"{_RUNS} SELECT model, setting, "
                    + ", ".join(f"{m}_mean AS {m}" for m in M.METRICS)
                    + f" FROM ({_summary_sql(10)})",
    "display_table": f"{_RUNS} SELECT model, setting, "
                     + ", ".join(f"{_text(m)} AS {m}" for m in M.METRICS)
                     + f" FROM ({_summary_sql(4)})",
}
ORACLES["filled_summary"] = "SELECT *, " + ", ".join(
    f"TRY_CAST(trim(split_part({m}, '±', 1)) AS DOUBLE) AS {m}_mean, CASE WHEN TRY_CAST(trim(split_part({m}, '±', 1)) AS DOUBLE) "
    f"IS NOT NULL THEN CASE WHEN contains({m}, '±') THEN TRY_CAST(trim(split_part({m}, '±', 2)) AS DOUBLE) ELSE 0.0 END END AS {m}_std"
    for m in M.METRICS) + f" FROM ({ORACLES['display_table']})"
ORACLES["labels_and_order"] = f"""{_RUNS},
disp AS (SELECT model, setting, {_text('accuracy')} AS accuracy FROM ({_summary_sql(4)}))
SELECT model, setting, {_SHORT} AS model_short, {_SSET} AS setting_short,
       ({_SHORT}) || chr(10) || '(' || ({_SSET}) || ')' AS label,
       {_EPS} AS epsilon, {_K} AS k,
       TRY_CAST(trim(split_part(accuracy, '±', 1)) AS DOUBLE) AS accuracy_mean,
       CASE WHEN contains(accuracy, '±') THEN TRY_CAST(trim(split_part(accuracy, '±', 2)) AS DOUBLE)
            ELSE 0.0 END AS accuracy_std,
       CASE WHEN contains(model, 'HE') THEN 'Encrypted Inference' ELSE 'Baseline' END AS he_setting,
       coalesce(contains(lower(setting), 'baseline'), false) AS is_baseline,
       CASE WHEN contains(setting, 'Baseline') THEN 99.0 ELSE -{_EPS} END AS dp_0,
       CASE WHEN contains(setting, 'Baseline') THEN (CASE WHEN model = 'Logistic Regression' THEN 0 ELSE 1 END)
            ELSE (CASE WHEN contains(model, 'Logistic') THEN 0 ELSE 1 END) END AS dp_1,
       CAST(CASE WHEN setting = 'Baseline (No Privacy)' THEN 99
            WHEN contains(setting, '3 clients, 10 rounds') THEN 1
            WHEN contains(setting, '5 clients, 20 rounds') THEN 2
            WHEN contains(setting, '10 clients, 20 rounds') THEN 3 ELSE 98 END AS DOUBLE) AS fl_0,
       CASE WHEN model IN ('Federated Logistic Regression', 'Logistic Regression') THEN 0
            WHEN model IN ('Federated Random Forest', 'Random Forest') THEN 1 ELSE 2 END AS fl_1,
       CAST(CASE WHEN contains(setting, 'Baseline') THEN 99
            WHEN {_K} IN (2, 5, 10, 20, 50, 100) THEN list_position([2, 5, 10, 20, 50, 100], {_K}) - 1
            ELSE 98 END AS DOUBLE) AS k_0,
       CASE WHEN contains(model, 'Logistic') THEN 0 WHEN contains(model, 'Random Forest') THEN 1
            ELSE 2 END AS k_1,
       CAST(CASE WHEN contains(model, 'Normal') OR model = 'Logistic Regression'
                   OR contains(setting, 'Baseline') THEN 0
            WHEN contains(model, 'HE') THEN 1 ELSE 2 END AS DOUBLE) AS he_0,
       0 AS he_1
FROM disp"""
ORACLES["tradeoff_table"] = f"""{_RUNS},
sel AS (SELECT *, unnest(CASE WHEN contains(model, 'HE ') OR contains(model, 'Normal') THEN ['HE']
                              WHEN contains(model, 'DP ') THEN ['DP']
                              WHEN contains(model, 'Federated') THEN ['FL']
                              WHEN contains(model, 'K-anonymised') THEN ['K-anonymity']
                              ELSE ['DP', 'FL', 'K-anonymity'] END) AS technique FROM metrics),
s AS (SELECT technique, model, setting, {rnd('avg(accuracy)', 10)} AS accuracy_mean,
             coalesce({rnd('stddev_samp(accuracy)', 10)}, 0.0) AS accuracy_std,
             {rnd('avg(f1)', 10)} AS f1_mean, coalesce({rnd('stddev_samp(f1)', 10)}, 0.0) AS f1_std
      FROM sel GROUP BY ALL),
fam AS (SELECT *, CASE WHEN contains(model, 'Logistic') THEN 'LR'
                       WHEN contains(model, 'Random Forest') THEN 'RF' ELSE 'other' END AS fam FROM s),
base AS (SELECT technique, fam, arg_min(accuracy_mean, model) AS base_accuracy_mean,
                arg_min(f1_mean, model) AS base_f1_mean
         FROM fam WHERE coalesce(contains(lower(setting), 'baseline'), false) GROUP BY technique, fam)
SELECT technique, model, setting, accuracy_mean, accuracy_std, f1_mean, f1_std,
       base_accuracy_mean, base_f1_mean
FROM fam LEFT JOIN base USING (technique, fam)
WHERE NOT coalesce(contains(lower(setting), 'baseline'), false)"""
