"""k-anonymity queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from privtab.functions import labels as L
from privtab.functions.exprs import band, recode
from privtab.operators import anonymity as K
from privtab.operators.sampling import stratified_split, with_seeds
from privtab.plans.sqlparts import K_VALUES, SEEDS, band_sql, split_ctes, sweep_sql
from privtab.sources import load

ORDER_QIS = ["o_orderstatus", "o_orderpriority", "o_year", "o_month"]
SPLIT_QIS = ["o_orderpriority", "o_year", "o_month"]
# Generalisation edges of the published study (age, income ratio).
AGE_EDGES = [0, 17, 29, 39, 49, 59, 69, 79, 120]
INCOME_EDGES = [-0.01, 1, 2, 3, 4, 5.1]


def orders_qi(spark, sf):
    o = load(spark, sf, "orders")
    return (o.withColumn("o_year", F.year("o_orderdate"))
             .withColumn("o_month", F.month("o_orderdate")))


def orders_labelled(spark, sf):
    """Orders with a binary target: status F -> 1, O -> 0 (P rows dropped)."""
    o = orders_qi(spark, sf).where(F.col("o_orderstatus").isin("F", "O"))
    return o.withColumn("target", recode("o_orderstatus", {"F": 1, "O": 0}).cast("int"))


def seeded_split(spark, sf, seeds=SEEDS):
    """X1 + E5: every labelled order once per seed, with ``is_test``."""
    x = with_seeds(orders_labelled(spark, sf), seeds)
    return stratified_split(x, "target", 0.2, F.col("seed"), "o_orderkey", by=["seed"])


def k_sweep_orders(spark, sf):
    """Flagship: k sweep over the order quasi-identifiers, one scan."""
    return K.k_sweep(orders_qi(spark, sf), ORDER_QIS, K_VALUES)


def k_suppress_rows(spark, sf):
    return K.k_suppress(orders_qi(spark, sf), ORDER_QIS, 10).select("o_orderkey", *ORDER_QIS)


def k_class_size_window(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return K.with_class_size(c, ["c_nationkey", "c_mktsegment"])


def _customer_nullable(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", "c_nationkey",
                    F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("segment"))


def k_null_policy(spark, sf):
    c = _customer_nullable(spark, sf)
    qis = ["c_nationkey", "segment"]
    sup = K.k_sweep(c, qis, K_VALUES, null_policy="suppress").withColumn("policy", F.lit("suppress"))
    grp = K.k_sweep(c, qis, K_VALUES, null_policy="group").withColumn("policy", F.lit("group"))
    return sup.unionByName(grp)


def k_sweep_seeds(spark, sf):
    train = seeded_split(spark, sf).where(~F.col("is_test"))
    return K.k_sweep(train, SPLIT_QIS, [1] + K_VALUES, by=["seed"])


def k_skip_reasons(spark, sf):
    train = seeded_split(spark, sf).where(~F.col("is_test"))
    stats = K.k_sweep(train, SPLIT_QIS, K_VALUES, by=["seed"], target="target")
    return K.skip_reason(stats).select(
        "seed", "k", L.setting_text("kanon", F.col("k")).alias("setting"),
        "train_rows_used", "pos_kept", "skipped_reason")


def band_right_closed(spark, sf):
    p = load(spark, sf, "part").select(
        F.lit("part").alias("src"), F.col("p_partkey").alias("id"),
        band("p_size", AGE_EDGES).alias("band"))
    c = load(spark, sf, "customer").select(
        F.lit("customer").alias("src"), F.col("c_custkey").alias("id"),
        band(F.col("c_acctbal") / 1000, INCOME_EDGES).alias("band"))
    return p.unionByName(c)


def k_banded(spark, sf):
    c = load(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment",
        band(F.col("c_acctbal") / 1000, INCOME_EDGES).alias("income_band"),
        band("c_nationkey", AGE_EDGES).alias("nation_band"))
    return K.k_sweep(c, ["income_band", "nation_band", "c_mktsegment"], K_VALUES)


QUERIES = {
    "k_sweep_orders": k_sweep_orders,
    "k_suppress_rows": k_suppress_rows,
    "k_class_size_window": k_class_size_window,
    "k_null_policy": k_null_policy,
    "k_sweep_seeds": k_sweep_seeds,
    "k_skip_reasons": k_skip_reasons,
    "band_right_closed": band_right_closed,
    "k_banded": k_banded,
}

_OQI = ("SELECT o_orderkey, o_orderstatus, o_orderpriority, "
        "CAST(year(o_orderdate) AS INTEGER) AS o_year, "
        "CAST(month(o_orderdate) AS INTEGER) AS o_month, o_custkey, o_totalprice FROM orders")
_LAB = (f"SELECT *, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS INTEGER) "
        f"AS target FROM ({_OQI}) WHERE o_orderstatus IN ('F', 'O')")

_SPLIT = f"WITH lab AS ({_LAB}),{split_ctes('lab', 'o_orderkey', 'target')}"

_INCOME = band_sql("c_acctbal / 1000", INCOME_EDGES)

ORACLES = {
    "k_sweep_orders": sweep_sql(
        "SELECT count(*) AS n, false AS unclassed FROM orders GROUP BY o_orderstatus, "
        "o_orderpriority, year(o_orderdate), month(o_orderdate)"),
    "k_suppress_rows": f"""
WITH b AS ({_OQI}),
s AS (SELECT o_orderstatus, o_orderpriority, o_year, o_month FROM b
      GROUP BY ALL HAVING count(*) >= 10)
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_year, o_month
FROM b SEMI JOIN s USING (o_orderstatus, o_orderpriority, o_year, o_month)""",
    "k_class_size_window": """
SELECT c_custkey, c_nationkey, c_mktsegment,
       count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS class_size
FROM customer""",
    "k_null_policy": f"""
SELECT *, 'suppress' AS policy FROM ({sweep_sql(
        "SELECT count(*) AS n, bool_or(segment IS NULL) AS unclassed FROM "
        "(SELECT c_nationkey, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer) "
        "GROUP BY c_nationkey, segment")})
UNION ALL
SELECT *, 'group' AS policy FROM ({sweep_sql(
        "SELECT count(*) AS n, false AS unclassed FROM "
        "(SELECT c_nationkey, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer) "
        "GROUP BY c_nationkey, segment")})""",
    "k_sweep_seeds": sweep_sql(
        f"{_SPLIT} SELECT seed, count(*) AS n, false AS unclassed FROM split "
        "WHERE NOT is_test GROUP BY seed, o_orderpriority, o_year, o_month",
        by="seed", ks=[1] + K_VALUES),
    "k_skip_reasons": f"""
SELECT seed, k, 'K-anonymity k=' || CAST(k AS VARCHAR) AS setting, train_rows_used, pos_kept,
       CASE WHEN train_rows_used = 0 THEN '{K.NO_ROWS}'
            WHEN pos_kept = 0 OR pos_kept = train_rows_used THEN '{K.ONE_CLASS}'
            ELSE '' END AS skipped_reason
FROM ({sweep_sql(
        f"{_SPLIT} SELECT seed, count(*) AS n, false AS unclassed, "
        "count(CASE WHEN target = 1 THEN 1 END) AS n_pos FROM split "
        "WHERE NOT is_test GROUP BY seed, o_orderpriority, o_year, o_month",
        by="seed", with_pos=True)})""",
    "band_right_closed": f"""
SELECT 'part' AS src, p_partkey AS id, {band_sql('p_size', AGE_EDGES)} AS band FROM part
UNION ALL
SELECT 'customer' AS src, c_custkey AS id, {_INCOME} AS band FROM customer""",
    "k_banded": sweep_sql(
        "SELECT count(*) AS n, bool_or(ib IS NULL OR nb IS NULL) AS unclassed FROM "
        f"(SELECT {_INCOME} AS ib, {band_sql('c_nationkey', AGE_EDGES)} AS nb, c_mktsegment "
        "FROM customer) GROUP BY ib, nb, c_mktsegment"),
}
