from pyspark.sql import functions as F

from privtab.operators import anonymity as K
from tests.conftest import SF_MID


def test_t4_null_policy(spark):
    df = spark.createDataFrame([("a", 1)] * 2 + [("a", None)] * 3, "q1 string, q2 int")
    assert K.k_suppress(df, ["q1", "q2"], 2).count() == 2
    assert K.k_suppress(df, ["q1", "q2"], 2, null_policy="group").count() == 5
    st = K.k_stats(df, ["q1", "q2"], 2).first()
    assert (st["train_rows_used"], st["rows_suppressed"], st["classes_before"]) == (2, 3, 1)
    sized = K.with_class_size(df, ["q1", "q2"], null_policy="group").collect()
    assert sorted(r["class_size"] for r in sized) == [2, 2, 3, 3, 3]


def test_k9_skip_reasons(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 0)] * 2 + [("c", 1)], "q string, y int")
    st = {r["k"]: r["skipped_reason"] for r in
          K.skip_reason(K.k_sweep(df, ["q"], [1, 3, 4], target="y")).collect()}
    assert st == {1: "", 3: K.ONE_CLASS, 4: K.NO_ROWS}


def _orders(spark):
    o = spark.read.parquet(f"{SF_MID}/orders.parquet")
    return o.withColumn("y", F.year("o_orderdate")).withColumn("m", F.month("o_orderdate"))


def test_sweep_matches_survey_probe(spark):
    qis = ["o_orderstatus", "o_orderpriority", "y", "m"]
    got = {r["k"]: (r["train_rows_used"], r["rows_suppressed"], r["suppression_rate"],
                    r["classes_after"], r["min_class_size"])
           for r in K.k_sweep(_orders(spark), qis, [2, 5, 10, 20, 50, 100]).collect()}
    assert got[2] == (14998, 2, 0.01, 1185, 4)
    assert got[5] == (14978, 22, 0.15, 1180, 5)
    assert got[10] == (13354, 1646, 10.97, 975, 10)
    assert got[20] == (783, 14217, 94.78, 37, 20)
    assert got[50] == (0, 15000, 100.0, 0, 0) == got[100]


def test_suppression_properties(spark):
    o = _orders(spark)
    qis = ["o_orderstatus", "o_orderpriority", "y", "m"]
    rows = sorted(K.k_sweep(o, qis, [1, 2, 5, 10, 20]).collect(), key=lambda r: r["k"])
    supp = [r["rows_suppressed"] for r in rows]
    assert supp == sorted(supp) and supp[0] == 0  # monotone; k = 1 keeps all
    kept = K.k_suppress(o, qis, 10)
    assert kept.groupBy(*qis).count().agg(F.min("count")).first()[0] >= 10
    # metamorphic: repartitioning the input changes nothing
    again = K.k_sweep(o.repartition(7), qis, [1, 2, 5, 10, 20]).collect()
    assert sorted(again, key=lambda r: r["k"]) == rows


def test_hot_class_third_of_rows(spark):
    """One equivalence class holds a third of all rows: results stay exact."""
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("c"), (F.col("id") % 97).cast("string"))).alias("q"),
        (F.col("id") % 2).cast("int").alias("y"))
    sized = K.with_class_size(hot, ["q"]).where(F.col("q") == "hot")
    assert sized.select("class_size").distinct().collect()[0][0] == 1000
    st = K.k_stats(hot, ["q"], 25).first()
    assert st["train_rows_used"] == K.k_suppress(hot, ["q"], 25).count()
    assert st["classes_before"] == 98


def test_baseline_suppresses_nothing(spark):
    from privtab.operators.anonymity import k_stats
    df = spark.createDataFrame([("a",), ("a",), (None,)], "q string")
    r = k_stats(df, ["q"], 1).first()
    assert (r["train_rows_used"], r["rows_suppressed"], r["suppression_rate"]) == (3, 0, 0.0)
    assert k_stats(df, ["q"], 2).first()["rows_suppressed"] == 1


def test_available_quasi_identifiers_and_model_features(spark):
    import pytest
    from privtab.operators.anonymity import model_features, quasi_identifiers
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert quasi_identifiers(df, ["b", "c", "a"]) == ["b", "a"]
    with pytest.raises(ValueError):
        quasi_identifiers(df, ["c"])
    assert model_features(["x", "y", "x_band", "z"], {"x": "x_band"}) == ["x_band", "y", "z"]
