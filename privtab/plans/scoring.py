"""Scoring queries with exact oracles (L4, F11, M1, M2, V4, D2 counts).

Rows: all orders joined to their customer, three features min-max scaled by
the labelled ones (E3), scored by fixed exported weights.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from privtab.functions import labels as L
from privtab.functions.exprs import recode, round_fixed
from privtab.operators import dp as D
from privtab.operators import masked as MK
from privtab.operators import metrics as M
from privtab.operators.encode import minmax_scale
from privtab.operators.linear import ensemble_mean as _ensemble_mean
from privtab.operators.linear import linear_score as _linear_score
from privtab.operators.sampling import stratified_split
from privtab.plans.kanon import _LAB, _OQI, _SPLIT, orders_labelled, orders_qi
from privtab.plans.sqlparts import md5_of, rnd
from privtab.session import materialize
from privtab.sources import load

FEATS = ["o_totalprice", "c_acctbal", "c_nationkey"]
WEIGHTS = {"o_totalprice": 2.5, "c_acctbal": -1.25, "c_nationkey": 0.75}
BIAS = -0.5
ENSEMBLE = [
    ({"o_totalprice": 2.5, "c_acctbal": -1.25, "c_nationkey": 0.75}, -0.5),
    ({"o_totalprice": -1.0, "c_acctbal": 2.0, "c_nationkey": 0.0}, 0.25),
    ({"o_totalprice": 0.5, "c_acctbal": 0.5, "c_nationkey": -3.0}, 1.0),
]
FOREST_TREES, FOREST_DEPTH, FOREST_SEED = 100, 5, 7
# Declared bounds of the features: known without looking at the data.
BOUNDS = {"o_totalprice": (0.0, 600_000.0), "c_acctbal": (-1000.0, 10_000.0), "c_nationkey": (0.0, 24.0)}


def _with_customer(spark, orders):
    c = load(spark, orders[0], "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey")
    return orders[1].join(c, "o_custkey")


def features(spark, sf, split: bool = False):
    """Scaled features of every order (fit on the labelled ones, applied to
    all); with ``split``, labelled orders with the seed-42 stratified split
    flag, added after scaling."""
    o = orders_qi(spark, sf)
    o = o.withColumn("target", F.when(F.col("o_orderstatus").isin("F", "O"),
                                      recode("o_orderstatus", {"F": 1, "O": 0})).cast("int"))
    rows = _with_customer(spark, (sf, o))
    scaled = minmax_scale(rows, FEATS, fit_on=rows.where(F.col("target").isNotNull()))
    if not split:
        return scaled
    return stratified_split(scaled.where(F.col("target").isNotNull()), "target", 0.2, 42, "o_orderkey")


def linear_score(spark, sf):
    s = _linear_score(features(spark, sf), WEIGHTS, BIAS)
    return s.select("o_orderkey", round_fixed("score", 10).alias("score"),
                    round_fixed("prob", 10).alias("prob"), "label")


def hidden_score(spark, sf):
    df = features(spark, sf)
    a, b = MK.share_tables(df, FEATS, "o_orderkey", seed=0)
    w = MK.weights_of(WEIGHTS, FEATS)
    sa = MK.score_share(a, w, "o_orderkey", "score_a")
    sb = MK.score_share(b, w, "o_orderkey", "score_b")
    r = MK.recombine(sa, sb, "o_orderkey", BIAS, a="score_a", b="score_b")
    return r.select("o_orderkey", "score_a", "score_b", round_fixed("score", 10).alias("score"),
                    "label")


def hidden_vs_plain(spark, sf):
    """M2: plain float scoring vs hidden fixed-point scoring on the seed-42
    test rows: metrics of both methods, side by side."""
    # both scoring paths read the test rows: materialise them once
    df = materialize(features(spark, sf, split=True).where(F.col("is_test")))
    plain = _linear_score(df, WEIGHTS, BIAS).select(
        "o_orderkey", F.col("target").alias("actual"), F.col("label").alias("predicted"),
        F.lit("Normal Logistic Regression").alias("method"))
    hid = MK.hidden_score(df, FEATS, MK.weights_of(WEIGHTS, FEATS), BIAS, "o_orderkey")
    hid = hid.join(df.select("o_orderkey", F.col("target").alias("actual")), "o_orderkey") \
             .select("o_orderkey", "actual", F.col("label").alias("predicted"),
                     F.lit("HE Logistic Regression Inference").alias("method"))
    return M.evaluate(plain.unionByName(hid), ["method"])


def method_settings(spark, sf):
    """runs that name a method only get their model and setting from it."""
    runs = hidden_vs_plain(spark, sf).withColumn("model", F.lit(None).cast("string"))
    runs = runs.withColumn("model", L.model_from_method("model", "method"))
    return runs.withColumn("setting", L.setting_from_model("model"))


def ensemble_mean(spark, sf):
    e = _ensemble_mean(features(spark, sf), ENSEMBLE)
    return e.select("o_orderkey", round_fixed("prob", 10).alias("prob"), "label")


def dp_forest_counts(spark, sf):
    """D2 data pass over the labelled orders, features by declared bounds."""
    rows = D.declare(_with_customer(spark, (sf, orders_labelled(spark, sf))), BOUNDS)
    trees = D.random_trees(FOREST_TREES, FOREST_DEPTH, len(FEATS), FOREST_SEED)
    return D.forest_leaf_counts(rows.private_rows(), rows.features, "target", "o_orderkey", {None: trees}, FOREST_DEPTH)


QUERIES = {
    "linear_score": linear_score,
    "hidden_score": hidden_score,
    "hidden_vs_plain": hidden_vs_plain,
    "method_settings": method_settings,
    "ensemble_mean": ensemble_mean,
    "dp_forest_counts": dp_forest_counts,
}


def _scaled(src: str, fit: str) -> str:
    parts = []
    for c in FEATS:
        mn = f"(SELECT min(CAST({c} AS DOUBLE)) FROM {fit})"
        mx = f"(SELECT max(CAST({c} AS DOUBLE)) FROM {fit})"
        parts.append(f"coalesce((CAST({c} AS DOUBLE) - {mn}) / nullif({mx} - {mn}, 0), 0.0) AS {c}")
    return ", ".join(parts)


_FEAT = f"""WITH lab AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS target FROM ({_OQI})),
j AS (SELECT lab.o_orderkey, lab.target, o_totalprice, c_acctbal, c_nationkey
      FROM lab JOIN customer ON o_custkey = c_custkey),
fit AS (SELECT * FROM j WHERE target IS NOT NULL),
f AS (SELECT o_orderkey, target, {_scaled('j', 'fit')} FROM j)"""


def declared_sql(col: str, low: float, high: float) -> str:
    """SQL twin of ``dp.declare`` for a column that is never NULL."""
    return (f"least(greatest((CAST({col} AS DOUBLE) - CAST('{low!r}' AS DOUBLE)) / CAST('{high - low!r}' AS DOUBLE), 0.0), 1.0)")


_DECLARED = f"""WITH lab AS ({_LAB}),
f AS (SELECT o_orderkey, target, {', '.join(f"{declared_sql(c, *b)} AS {c}" for c, b in BOUNDS.items())}
      FROM lab JOIN customer ON o_custkey = c_custkey)"""


def _score_sql(weights, bias) -> str:
    s = f"CAST({float(bias)!r} AS DOUBLE)"
    for c, w in weights.items():
        s = f"({s} + {c} * CAST({float(w)!r} AS DOUBLE))"
    return s


def _sig(s: str) -> str:
    return f"(1.0 / (1.0 + exp(-({s}))))"


_P = MK.MODULUS


def _hidden_sql(src: str) -> str:
    """Shares, per-party scores and recombination over ``src`` (o_orderkey, FEATS)."""
    x = [f"CAST(round({c} * 1048576.0) AS HUGEINT)" for c in FEATS]
    r = [f"(CAST(('0x' || substr(md5(concat_ws(':', '0', CAST(o_orderkey AS VARCHAR), '{j}')), 1, 16))"
         f"::UBIGINT AS HUGEINT) % {_P})" for j in range(len(FEATS))]
    w = [MK.fixed_weight(WEIGHTS[c]) for c in FEATS]
    sa = " + ".join(f"({wj}) * {rj}" for wj, rj in zip(w, r))
    sb = " + ".join(f"({wj}) * ((({xj} - {rj}) % {_P} + {_P}) % {_P})"
                    for wj, xj, rj in zip(w, x, r))
    return f"""sh AS (SELECT o_orderkey, (({sa}) % {_P} + {_P}) % {_P} AS score_a,
                    (({sb}) % {_P} + {_P}) % {_P} AS score_b FROM {src}),
rc AS (SELECT o_orderkey, CAST(score_a AS BIGINT) AS score_a, CAST(score_b AS BIGINT) AS score_b,
              (score_a + score_b) % {_P} AS t FROM sh),
hs AS (SELECT o_orderkey, score_a, score_b,
              CAST(CASE WHEN t > {_P // 2} THEN t - {_P} ELSE t END AS DOUBLE) / 1099511627776.0
                + CAST({BIAS!r} AS DOUBLE) AS score FROM rc)"""


def _forest_sql() -> str:
    feats, ths = D.random_trees(FOREST_TREES, FOREST_DEPTH, len(FEATS), FOREST_SEED)
    trees = ", ".join(f"({i}, {f.tolist()}, [{', '.join(f'CAST({t!r} AS DOUBLE)' for t in th.tolist())}])"
                      for i, (f, th) in enumerate(zip(feats, ths)))
    x = "[" + ", ".join(FEATS) + "]"
    ctes = [f"""l0 AS (SELECT CAST((('0x' || substr({md5_of("'0'", 'o_orderkey')}, 1, 8))::BIGINT)
                       % {FOREST_TREES} AS INTEGER) AS tree, {x} AS x, target, 0 AS n FROM f)""",
            f"l0t AS (SELECT l0.*, tf, tt FROM l0 JOIN (VALUES {trees}) tr(tid, tf, tt) "
            "ON l0.tree = tr.tid)"]
    prev = "l0t"
    for i in range(1, FOREST_DEPTH + 1):
        ctes.append(f"l{i} AS (SELECT tree, x, target, tf, tt, 2 * n + 1 + "
                    f"CASE WHEN x[tf[n + 1] + 1] > tt[n + 1] THEN 1 ELSE 0 END AS n FROM {prev})")
        prev = f"l{i}"
    leaves = 2 ** FOREST_DEPTH - 1
    return (_DECLARED + ",\n" + ",\n".join(ctes) +
            f"\nSELECT tree, CAST(n - {leaves} AS INTEGER) AS leaf, CAST(target AS INTEGER) AS label,"
            f" count(*) AS n FROM {prev} GROUP BY ALL")


_ENS = " + ".join(_sig(_score_sql(w, b)) for w, b in ENSEMBLE)

ORACLES = {
    "linear_score": f"""{_FEAT}
SELECT o_orderkey, {rnd(_score_sql(WEIGHTS, BIAS), 10)} AS score,
       {rnd(_sig(_score_sql(WEIGHTS, BIAS)), 10)} AS prob,
       CASE WHEN {_sig(_score_sql(WEIGHTS, BIAS))} >= 0.5 THEN 1 ELSE 0 END AS label FROM f""",
    "hidden_score": f"""{_FEAT}, {_hidden_sql('f')}
SELECT o_orderkey, score_a, score_b, {rnd('score', 10)} AS score,
       CASE WHEN {_sig('score')} >= 0.5 THEN 1 ELSE 0 END AS label FROM hs""",
    "ensemble_mean": f"""{_FEAT}
SELECT o_orderkey, {rnd(f'({_ENS}) / {float(len(ENSEMBLE))}', 10)} AS prob,
       CASE WHEN ({_ENS}) / {float(len(ENSEMBLE))} >= 0.5 THEN 1 ELSE 0 END AS label FROM f""",
    "dp_forest_counts": _forest_sql(),
}

_SPLIT42 = _SPLIT.replace("CROSS JOIN (SELECT unnest([42, 43, 44, 45, 46]) AS seed)",
                          "CROSS JOIN (SELECT unnest([42]) AS seed)")
ORACLES["hidden_vs_plain"] = f"""{_SPLIT42},
j AS (SELECT split.o_orderkey, split.target, split.is_test, o_totalprice, c_acctbal, c_nationkey
      FROM split JOIN customer ON o_custkey = c_custkey),
f0 AS (SELECT o_orderkey, target, is_test, {_scaled('j', 'j')} FROM j),
f AS (SELECT * FROM f0 WHERE is_test),
{_hidden_sql('f')},
preds AS (
  SELECT 'Normal Logistic Regression' AS method, target AS actual,
         CASE WHEN {_sig(_score_sql(WEIGHTS, BIAS))} >= 0.5 THEN 1 ELSE 0 END AS predicted FROM f
  UNION ALL
  SELECT 'HE Logistic Regression Inference', f.target,
         CASE WHEN {_sig('hs.score')} >= 0.5 THEN 1 ELSE 0 END FROM hs JOIN f USING (o_orderkey)),
cells AS (SELECT method,
                 count(CASE WHEN actual = 0 AND predicted = 0 THEN 1 END) AS tn,
                 count(CASE WHEN actual = 0 AND predicted = 1 THEN 1 END) AS fp,
                 count(CASE WHEN actual = 1 AND predicted = 0 THEN 1 END) AS fn,
                 count(CASE WHEN actual = 1 AND predicted = 1 THEN 1 END) AS tp
          FROM preds GROUP BY method)
SELECT method,
   coalesce(CAST(tp + tn AS DOUBLE) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0.0) AS accuracy,
   coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
   coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
   coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall
FROM cells"""
ORACLES["method_settings"] = f"""SELECT *, method AS model, CASE WHEN contains(method, 'HE') THEN 'Encrypted Inference'
  ELSE 'Baseline' END AS setting FROM ({ORACLES['hidden_vs_plain']})"""
