"""Cohort preparation queries: joins, cleaning, encoding, sampling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from privtab.operators import clean as C
from privtab.operators import encode as E
from privtab.operators.joins import join_all
from privtab.operators.report import class_distribution as _class_distribution
from privtab.operators.sampling import assign_silo, sample_exact
from privtab.plans.kanon import _SPLIT, seeded_split
from privtab.plans.sqlparts import md5_of
from privtab.session import materialize
from privtab.sources import load

SITE_SETTINGS = [3, 5, 10]


def profile_orders(spark, sf):
    """Guard the wanted columns, drop date columns if present,
    report the shape of the projected table."""
    from privtab.sources import existing, profile
    o = load(spark, sf, "orders")
    wanted = existing(o, ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate",
                          "o_shipdate", "o_orderstatus"])
    proj = o.select(*wanted).drop("o_orderdate", "o_shipdate")
    return profile(proj)


def join_three(spark, sf):
    """Orders ⋈ customer ⋈ nation, projected."""
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"),
                                         "o_totalprice")
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"),
                                           F.col("c_nationkey").alias("nationkey"), "c_acctbal")
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return join_all([o, c], "custkey").join(n, "nationkey")


def join_labels(spark, sf):
    """Documents ⋈ labels on doc_id (unmatched documents drop)."""
    d = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = load(spark, sf, "labels")
    return join_all([d, lab], "doc_id")


def clean_strict(spark, sf):
    """Project, drop sentinel rows, drop NULL rows, keep/recode target."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                         "o_orderpriority")
    c = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("segment"))
    df = o.join(c, "o_custkey")
    df = df.withColumn("o_orderpriority",
                       F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Unknown"))
                        .otherwise(F.col("o_orderpriority")))
    out = C.strict_recipe(df.select("o_orderkey", "o_orderpriority", "segment", "o_orderstatus"),
                          ["o_orderkey", "o_orderpriority", "segment"], "o_orderstatus", "F", "O")
    return out.withColumnRenamed("o_orderstatus", "target")


def _customer_holes(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_acctbal")).alias("acctbal"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("segment"),
        F.when(F.col("c_nationkey") < 15, None).otherwise(F.col("c_nationkey")).alias("nation"))


def clean_impute(spark, sf):
    """Prune columns >= 50 % NULL, median/constant fill."""
    df = _customer_holes(spark, sf)
    return C.impute_recipe(df, ["acctbal", "segment", "nation"])


def null_ratios(spark, sf):
    """A5: NULL share per column, one scan."""
    return C.null_ratio(_customer_holes(spark, sf))


def coerce_numeric(spark, sf):
    """Numeric text -> double (bad text -> NULL), ids -> text."""
    ev = load(spark, sf, "events").select(
        "event_id",
        F.regexp_extract("props", r'"k": *([^,}]*)', 1).alias("k_text"),
        F.col("event_type").alias("type_text"),
        F.col("user_id").cast("string").alias("user_text"))
    return C.to_numeric(ev, ["k_text", "type_text"])


def class_distribution(spark, sf):
    """A4: class counts and percentages of the toxic label."""
    lab = load(spark, sf, "labels")
    return _class_distribution(lab, "toxic", {0: "Non-toxic (0)", 1: "Toxic (1)"})


def label_encode(spark, sf):
    """Sorted-order codes for text columns."""
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return E.label_encode(c, ["c_mktsegment", "c_name"])


def minmax_all(spark, sf):
    """Min-max fitted on all rows."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return E.minmax_scale(o, ["o_totalprice", "o_custkey"])


def minmax_train_only(spark, sf):
    """Fitted on the training rows of seed 42, applied to every row."""
    sp = seeded_split(spark, sf, [42]).select("o_orderkey", "is_test", "o_totalprice",
                                              "o_custkey")
    return E.minmax_scale(sp, ["o_totalprice", "o_custkey"], fit_on=sp.where(~F.col("is_test")))


def sample_exact_q(spark, sf):
    """Exactly 1,000 orders, seeded."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sample_exact(o, 1000, 42, "o_orderkey")


def split_stratified(spark, sf):
    """E5: stratified 80/20 split for five seeds in one job."""
    return seeded_split(spark, sf).select("seed", "o_orderkey", "target", "is_test")


def split_sizes(spark, sf):
    """E5: test/train sizes per seed and class."""
    sp = seeded_split(spark, sf)
    return sp.groupBy("seed", "target", "is_test").agg(F.count(F.lit(1)).alias("n"))


def balanced_weights(spark, sf):
    """N / (2 n_c) on every labelled document."""
    return E.balanced_weights(load(spark, sf, "labels").select("doc_id", "toxic"), "toxic")


def silo_assign(spark, sf):
    """The train rows of each seed split into 3, 5 and 10 sites."""
    # the split feeds a second cut search: materialise it once
    train = materialize(seeded_split(spark, sf).where(~F.col("is_test"))
                        .select("seed", "o_orderkey"))
    x = train.withColumn("n_sites", F.explode(F.array(*[F.lit(p) for p in SITE_SETTINGS])))
    return assign_silo(x, F.col("n_sites"), F.col("seed"), "o_orderkey", by=["seed", "n_sites"])


QUERIES = {
    "profile_orders": profile_orders,
    "join_three": join_three,
    "join_labels": join_labels,
    "clean_strict": clean_strict,
    "clean_impute": clean_impute,
    "null_ratios": null_ratios,
    "coerce_numeric": coerce_numeric,
    "class_distribution": class_distribution,
    "label_encode": label_encode,
    "minmax_all": minmax_all,
    "minmax_train_only": minmax_train_only,
    "sample_exact": sample_exact_q,
    "split_stratified": split_stratified,
    "split_sizes": split_sizes,
    "balanced_weights": balanced_weights,
    "silo_assign": silo_assign,
}

_HOLES = """SELECT c_custkey,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS acctbal,
       nullif(c_mktsegment, 'HOUSEHOLD') AS segment,
       CASE WHEN c_nationkey < 15 THEN NULL ELSE c_nationkey END AS nation
FROM customer"""


def _minmax_sql(src: str, fit: str, cols) -> str:
    parts = []
    for c in cols:
        mn = f"(SELECT min(CAST({c} AS DOUBLE)) FROM {fit})"
        mx = f"(SELECT max(CAST({c} AS DOUBLE)) FROM {fit})"
        parts.append(f"coalesce((CAST({c} AS DOUBLE) - {mn}) / nullif({mx} - {mn}, 0), 0.0)"
                     f" AS {c}")
    return ", ".join(parts)


ORACLES = {
    "profile_orders": "SELECT count(*) AS n_rows, 4 AS n_columns FROM orders",
    "join_three": """
SELECT c_nationkey AS nationkey, o_custkey AS custkey, o_orderkey, o_totalprice, c_acctbal, n_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "join_labels": """
SELECT d.doc_id, lang, source, n_chars, quality, toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "clean_strict": """
SELECT o_orderkey, o_orderpriority, segment,
       CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS INTEGER) AS target
FROM (SELECT o_orderkey, o_orderstatus,
             CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown'
                  ELSE o_orderpriority END AS o_orderpriority,
             nullif(c_mktsegment, 'HOUSEHOLD') AS segment
      FROM orders JOIN customer ON o_custkey = c_custkey)
WHERE o_orderpriority NOT IN ('Missing', 'Unknown', 'NA', 'NaN')
  AND segment IS NOT NULL AND o_orderstatus IN ('F', 'O')""",
    "clean_impute": f"""
WITH h AS ({_HOLES})
SELECT c_custkey,
       coalesce(CAST(acctbal AS DOUBLE), (SELECT median(acctbal) FROM h)) AS acctbal,
       coalesce(segment, 'Unknown') AS segment
FROM h""",
    "null_ratios": f"""
WITH h AS ({_HOLES})
SELECT avg(CASE WHEN c_custkey IS NULL THEN 1.0 ELSE 0.0 END) AS c_custkey,
       avg(CASE WHEN acctbal IS NULL THEN 1.0 ELSE 0.0 END) AS acctbal,
       avg(CASE WHEN segment IS NULL THEN 1.0 ELSE 0.0 END) AS segment,
       avg(CASE WHEN nation IS NULL THEN 1.0 ELSE 0.0 END) AS nation
FROM h""",
    "coerce_numeric": """
SELECT event_id,
       TRY_CAST(trim(regexp_extract(props, '"k": *([^,}]*)', 1)) AS DOUBLE) AS k_text,
       TRY_CAST(trim(event_type) AS DOUBLE) AS type_text,
       CAST(user_id AS VARCHAR) AS user_text
FROM events""",
    "class_distribution": """
SELECT toxic, count(*) AS count,
       CAST((20000 * count(*) + sum(count(*)) OVER ()) // (2 * sum(count(*)) OVER ()) AS DOUBLE)
         / 100 AS percentage,
       CASE toxic WHEN 0 THEN 'Non-toxic (0)' WHEN 1 THEN 'Toxic (1)' END AS label
FROM labels GROUP BY toxic""",
    "label_encode": """
SELECT c_custkey,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment,
       CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name
FROM customer""",
    "minmax_all": f"""
SELECT o_orderkey, {_minmax_sql('orders', 'orders', ['o_totalprice', 'o_custkey'])}
FROM orders""",
    "minmax_train_only": f"""
{_SPLIT.replace('split_x AS', 'split_x AS', 1).replace(
        'CROSS JOIN (SELECT unnest([42, 43, 44, 45, 46]) AS seed)',
        'CROSS JOIN (SELECT unnest([42]) AS seed)')},
tr AS (SELECT * FROM split WHERE NOT is_test)
SELECT o_orderkey, is_test, {_minmax_sql('split', 'tr', ['o_totalprice', 'o_custkey'])}
FROM split""",
    "sample_exact": f"""
SELECT o_orderkey, o_orderstatus FROM orders
ORDER BY {md5_of("42", "o_orderkey")}, o_orderkey LIMIT 1000""",
    "split_stratified": f"{_SPLIT} SELECT seed, o_orderkey, target, is_test FROM split",
    "split_sizes": f"{_SPLIT} SELECT seed, target, is_test, count(*) AS n FROM split GROUP BY ALL",
    "balanced_weights": """
SELECT doc_id, toxic,
       CAST(sum(count(*)) OVER () AS DOUBLE) / CAST(2 * count(*) AS DOUBLE) AS weight
FROM labels GROUP BY doc_id, toxic""",
    "silo_assign": None,
}

ORACLES["balanced_weights"] = """
WITH c AS (SELECT toxic, count(*) AS n_c FROM labels GROUP BY toxic),
t AS (SELECT sum(n_c) AS n, count(*) AS k FROM c)
SELECT doc_id, l.toxic, CAST(n AS DOUBLE) / CAST(k * n_c AS DOUBLE) AS weight
FROM labels l JOIN c USING (toxic) CROSS JOIN t"""
ORACLES["silo_assign"] = f"""
{_SPLIT},
tr AS (SELECT seed, o_orderkey FROM split WHERE NOT is_test),
x AS (SELECT tr.*, p.n_sites FROM tr CROSS JOIN (SELECT unnest([3, 5, 10]) AS n_sites) p)
SELECT seed, o_orderkey, CAST(n_sites AS INTEGER) AS n_sites,
       CAST(ntile(n_sites) OVER (PARTITION BY seed, n_sites
            ORDER BY {md5_of('seed', 'o_orderkey')}, o_orderkey) - 1 AS INTEGER) AS silo
FROM x"""
