"""Plan shape checks: the properties that matter at scale, read off the
physical plans of registered queries."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_MID

SCALE_QUERIES = ["k_sweep_orders", "k_sweep_seeds", "split_stratified", "silo_assign",
                 "k_suppress_rows", "confusion_long", "hidden_score", "clean_strict"]


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SCALE_QUERIES)
def test_no_pairs_no_unpartitioned_windows(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_MID))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for spec in re.findall(r"windowspecdefinition\(([^,)]*)", plan):
        first = spec.strip()
        assert not (first.endswith("FIRST") or first.endswith("LAST")
                    or first.startswith("specifiedwindowframe")), f"unpartitioned window: {spec}"


def test_window_check_detects_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    bad = spark.range(5).withColumn("r", F.row_number().over(Window.orderBy("id")))
    specs = re.findall(r"windowspecdefinition\(([^,)]*)", _plan(bad))
    assert specs and specs[0].strip().endswith("FIRST")


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(entry.queries()["clean_strict"](spark, SF_MID))
    assert re.search(r"PushedFilters: \[[^\]]*In\(o_orderstatus", plan)
    plan = _plan(entry.queries()["k_sweep_orders"](spark, SF_MID))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("o_totalprice" not in s and "o_custkey" not in s for s in schemas)


@pytest.fixture
def no_static_broadcast(spark):
    """Estimates alone broadcast nothing; only stored tables of checked size are."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    yield
    spark.conf.set(key, before)


def test_fitted_tables_do_not_shuffle_rows(spark, no_static_broadcast):
    """Cuts, class weights and per-group minima meet the rows without an Exchange of rows."""
    from privtab.operators import encode, sampling
    o = spark.read.parquet(f"{SF_MID}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    plans = [sampling.stratified_split(o, "o_orderstatus", 0.2, 42, "o_orderkey"),
             sampling.assign_silo(o, 5, 42, "o_orderkey", by=["o_orderstatus"]),
             sampling.sample_exact(o, 100, 42, "o_orderkey"),
             encode.balanced_weights(o, "o_orderstatus"),
             encode.minmax_by(o, ["o_totalprice"], ["o_orderstatus"])]
    for df in plans:
        plan = _plan(df)
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan, plan
        assert "BroadcastHashJoin" in plan or "_g" in plan


def test_share_tables_meet_without_an_exchange(spark, no_static_broadcast):
    plan = _plan(entry.queries()["hidden_score"](spark, SF_MID))
    assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
    assert plan.count("Bucketed: true") == 2 or plan.count("SelectedBucketsCount") == 2, plan
    assert "o_totalprice" not in plan  # features are read when the tables are written, not here


def test_a_large_fitted_table_is_not_broadcast(spark, no_static_broadcast, monkeypatch):
    from privtab import session
    from privtab.operators import encode
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    o = spark.read.parquet(f"{SF_MID}/orders.parquet").select("o_orderkey", "o_orderstatus")
    assert "SortMergeJoin" in _plan(encode.balanced_weights(o, "o_orderstatus"))
