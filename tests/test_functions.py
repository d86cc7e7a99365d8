"""Semantic traps of SURVEY §1.1 / FIXTURES §4 on hand-made rows."""

import pytest

from privtab.functions import (band, combined_label, epsilon_of, finite_or, k_of, mean_of,
                               mean_std_text, short_model, short_setting, std_of, threshold)
from privtab.functions.exprs import round_half_up_ratio

AGE = [0, 17, 29, 39, 49, 59, 69, 79, 120]


def test_t1_bands_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 17.0, 17.5, 29.0, 120.0, 121.0, -1.0, None]],
                               "x double")
    got = [r[0] for r in df.select(band("x", AGE)).collect()]
    assert got == [0, 0, 1, 1, 7, None, None, None]


def test_t5_t12_finite_or(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (3.0,),
                                (None,)], "x double")
    assert [r[0] for r in df.select(finite_or("x", 0.0)).collect()] == [0.0, 0.0, 0.0, 3.0, 0.0]


def test_t11_threshold_at_half(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (0.9,)], "p double")
    assert [r[0] for r in df.select(threshold("p")).collect()] == [1, 0, 1]


def test_half_up_ratio_exact(spark):
    df = spark.createDataFrame([(1, 8), (1, 32), (2, 3), (0, 0), (5, 7)], "a long, b long")
    got = [r[0] for r in df.select(round_half_up_ratio("a", "b", 2, 100)).collect()]
    assert got == [12.5, 3.13, 66.67, 0.0, 71.43]


def test_f6_mean_std_text(spark):
    df = spark.createDataFrame([(0.12345, None), (None, 0.1), (0.5, 0.25)], "m double, s double")
    got = [r[0] for r in df.select(mean_std_text("m", "s")).collect()]
    assert got[1] == "NA"
    assert got[0].endswith(" ± 0.0000") and got[2] == "0.5000 ± 0.2500"


def test_f1_f2_f3_labels(spark):
    rows = [("DP Logistic Regression", "DP e=0.5"),
            ("Random Forest", "Baseline (No Privacy)"),
            ("K-anonymised Random Forest", "K-anonymity K=20"),
            ("Federated Logistic Regression", "FL (3 clients, 10 rounds)"),
            ("HE Logistic Regression Inference", "Encrypted Inference"),
            ("Mystery", "something else")]
    df = spark.createDataFrame(rows, "m string, s string")
    out = df.select(short_model("m"), short_setting("s"), combined_label("m", "s")).collect()
    assert [r[0] for r in out] == ["DP LR", "RF", "K-Anon RF", "FL LR", "HE LR", "Mystery"]
    assert [r[1] for r in out] == ["ε=0.5", "Baseline", "k=20", "3 clients\n10 rounds",
                                   "Encrypted", "something else"]
    assert out[0][2] == "DP LR\n(ε=0.5)"


def test_f4_f5_f7_parsing(spark):
    df = spark.createDataFrame([("0.9008 ± 0.0038", "DP e=10.0"), ("0.75", "K-anonymity k=5"),
                                ("oops", "Baseline")], "t string, s string")
    out = df.select(mean_of("t"), std_of("t"), epsilon_of("s"), k_of("s")).collect()
    assert out[0][0] == pytest.approx(0.9008) and out[0][1] == pytest.approx(0.0038)
    assert out[1][0] == 0.75 and out[1][1] == 0.0
    assert out[2][0] is None
    assert out[0][2] == 10.0 and out[1][3] == 5 and out[2][2] is None and out[2][3] is None
