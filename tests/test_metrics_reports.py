import pytest
from pyspark.sql import functions as F

from privtab.operators import metrics as M
from privtab.operators import report as R


def test_golden_anchor_from_confusion(spark):
    conf = spark.createDataFrame([("r", 0, 8206, 1308), ("r", 1, 42, 444)],
                                 "run string, actual_class int, predicted_0 long, predicted_1 long")
    m = M.metrics_from_confusion(conf, ["run"]).first()
    assert m["accuracy"] == pytest.approx(0.865)
    assert m["f1"] == pytest.approx(0.39678, abs=1e-5)


def test_a11_absent_class_rows_filled(spark):
    df = spark.createDataFrame([("r", 0, 0)] * 3, "run string, actual int, predicted int")
    rows = sorted(M.confusion(df, ["run"]).collect(), key=lambda r: r["actual_class"])
    assert [(r["actual_class"], r["predicted_0"], r["predicted_1"]) for r in rows] == [
        (0, 3, 0), (1, 0, 0)]


def test_t7_zero_division(spark):
    df = spark.createDataFrame([("r", 1, 0), ("r", 0, 0)], "run string, actual int, predicted int")
    m = M.evaluate(df, ["run"]).first()
    assert (m["precision"], m["f1"], m["recall"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_t6_single_run_std_and_display(spark):
    df = spark.createDataFrame([("m", "s", 0.9)], "model string, setting string, accuracy double")
    s = R.summarise(df, ["model", "setting"], ["accuracy"], digits=4)
    assert s.first()["accuracy_std"] is None
    d = R.display_table(s, ["model", "setting"], ["accuracy"]).first()
    assert d["accuracy"] == "0.9000 ± 0.0000"


def test_with_baseline_and_orders(spark):
    rows = [("Logistic Regression", "Baseline (No Privacy)", 0.9),
            ("Random Forest", "Baseline (No Privacy)", 0.8),
            ("DP Logistic Regression", "DP e=1.0", 0.7),
            ("DP Random Forest", "DP e=10.0", 0.6)]
    df = spark.createDataFrame(rows, "model string, setting string, acc double")
    j = {r["model"]: r["base_acc"] for r in R.with_baseline(df, "model", "setting", ["acc"]).collect()}
    assert j == {"DP Logistic Regression": 0.9, "DP Random Forest": 0.8}
    o = df.select("model", *R.dp_order("model", "setting")).orderBy("order_1", "order_2")
    assert [r["model"] for r in o.collect()] == ["DP Random Forest", "DP Logistic Regression",
                                                "Logistic Regression", "Random Forest"]


def test_runtime_column_either_name(spark):
    df = spark.createDataFrame([(1.5,)], "`Train Time (s)` double")
    assert R.runtime_column(df).first()["runtime"] == 1.5


def test_u1_union_by_name_with_missing_columns(spark):
    a = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    b = spark.createDataFrame([("n", 0.7, "why")], "model string, accuracy double, reason string")
    u = R.union_results([a, b]).collect()
    assert len(u) == 2 and {r["reason"] for r in u} == {None, "why"}


def test_runtime_from_text_and_preview(spark):
    from privtab.operators.report import runtime_column
    from privtab.sources.tables import preview
    df = spark.createDataFrame([("0.0123 ± 0.0040",), (None,)], ["Train Time (s) mean ± std"])
    assert [r["runtime"] for r in runtime_column(df).collect()] == [0.0123, None]
    assert preview(spark.range(10), 3).count() == 3


def test_baseline_of_the_own_technique(spark):
    rows = [("Logistic Regression", "Baseline (No Privacy)", 0.7),
            ("Normal Logistic Regression", "Baseline", 0.9),
            ("DP Logistic Regression", "DP e=1.0", 0.6),
            ("HE Logistic Regression Inference", "Encrypted Inference", 0.89)]
    df = spark.createDataFrame(rows, "model string, setting string, accuracy double")
    df = df.withColumn("technique", F.explode(R.techniques("model")))
    out = R.with_baseline(df, "model", "setting", ["accuracy"], by=["technique"])
    got = {r["technique"]: r["base_accuracy"] for r in out.collect()}
    assert got == {"DP": 0.7, "HE": 0.9}


def test_mean_and_std_are_filled_from_text(spark):
    from privtab.operators.report import fill_mean_std
    rows = [("a", "0.91 ± 0.02", "0.5", 7.0), ("b", "n/a", None, 8.0), ("c", "1 ± x", "0.25 ± 0", 9.0)]
    df = spark.createDataFrame(rows, "model string, accuracy string, f1 string, recall_mean double").withColumn("recall", F.lit("1 ± 1"))
    got = {r.model: r for r in fill_mean_std(df, ["accuracy", "f1", "recall", "precision"]).collect()}
    assert (got["a"].accuracy_mean, got["a"].accuracy_std, got["a"].f1_mean, got["a"].f1_std) == (0.91, 0.02, 0.5, 0.0)
    assert (got["b"].accuracy_mean, got["b"].accuracy_std, got["b"].f1_mean, got["b"].f1_std) == (None,) * 4
    assert got["c"].accuracy_std is None and got["c"].f1_mean == 0.25 and got["c"].recall_mean == 9.0
    assert not {"precision_mean", "recall_std"} & set(got["a"].asDict())


def test_model_from_method(spark):
    from privtab.functions.labels import model_from_method, setting_from_model
    df = spark.createDataFrame([("M", "x"), (None, "HE y"), (None, None)], "model string, method string")
    got = df.select(model_from_method("model", "method").alias("m"), setting_from_model(model_from_method("model", "method")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("M", "Baseline"), ("HE y", "Encrypted Inference"), (None, "Baseline")]
