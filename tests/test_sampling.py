from pyspark.sql import Window
from pyspark.sql import functions as F

from privtab.functions.hashing import hash_hex
from privtab.operators.sampling import assign_silo, sample_exact, stratified_split, with_seeds


def _frame(spark, n=3000):
    # class 1 is a third of the rows; keys unique
    return spark.range(n).select(F.col("id").alias("key"),
                                 (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_split_matches_window_form_and_sizes(spark):
    df = with_seeds(_frame(spark), [1, 2])
    sp = stratified_split(df, "y", 0.2, F.col("seed"), "key", by=["seed"])
    w = Window.partitionBy("seed", "y").orderBy(hash_hex(F.col("seed"), "key"), "key")
    ref = df.withColumn("rn", F.row_number().over(w))
    quota = {(1, 0): 400, (1, 1): 200, (2, 0): 400, (2, 1): 200}
    got = sp.where("is_test").select("seed", "key").collect()
    exp = [r for r in ref.collect() if r["rn"] <= quota[(r["seed"], r["y"])]]
    assert sorted((r["seed"], r["key"]) for r in got) == sorted((r["seed"], r["key"]) for r in exp)
    assert sp.count() == df.count()  # disjoint and complete


def test_split_remainder_goes_to_largest_fraction(spark):
    df = spark.range(7).select(F.col("id").alias("key"), (F.col("id") < 4).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in
             stratified_split(df, "y", 0.2, 42, "key").where("is_test").groupBy("y").count().collect()}
    assert sum(sizes.values()) == 2  # ceil(0.2 * 7)


def test_sample_exact(spark):
    df = _frame(spark)
    s = sample_exact(df, 123, 7, "key")
    assert s.count() == 123 and s.select("key").distinct().count() == 123
    assert sample_exact(df, 5000, 7, "key").count() == 3000  # not larger -> all rows


def test_silo_sizes_like_ntile(spark):
    df = _frame(spark, 1003)
    sizes = sorted(r["count"] for r in assign_silo(df, 10, 3, "key")
                   .groupBy("silo").count().collect())
    assert sizes == [100] * 7 + [101] * 3
    one = assign_silo(df, 1, 3, "key")
    assert one.select("silo").distinct().collect()[0][0] == 0


def test_many_groups(spark):
    df = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 10).alias("g"))
    s = sample_exact(df, 7, 5, "key", by=["g"])
    sizes = {r["g"]: r["count"] for r in s.groupBy("g").count().collect()}
    assert sizes == {g: 7 for g in range(10)}


def test_null_groups_are_groups(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), F.when(F.col("id") >= 1000, 1).alias("g"))
    assert {r["g"]: r["count"] for r in sample_exact(df, 10, 1, "key", by=["g"]).groupBy("g").count().collect()} == {None: 10, 1: 10}
    split = stratified_split(df, "g", 0.2, 1, "key")
    assert {r["g"]: r["count"] for r in split.where("is_test").groupBy("g").count().collect()} == {None: 200, 1: 200}
    sites = assign_silo(df, 4, 1, "key", by=["g"]).groupBy("g", "silo").count().collect()
    assert len(sites) == 8 and all(r["count"] == 250 for r in sites)


def test_key_that_repeats_at_a_cut_is_refused(spark):
    import pytest
    df = spark.range(100).select(F.lit(7).alias("key"))
    with pytest.raises(Exception, match="not unique"):
        sample_exact(df, 10, 1, "key").count()


def test_labels_take_one_scan(spark):
    """No window and no union: each row is compared with its group's cuts."""
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus")
    plan = stratified_split(df, "o_orderstatus", 0.2, 42, "o_orderkey")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey#") == 1 and "Window" not in plan and "Union" not in plan
    assert plan.count("Relation [") == 2  # the rows, and the stored table of cuts


def test_large_buckets_are_refined(spark, monkeypatch):
    """The second digit level gives the same cuts as ranking whole buckets."""
    from privtab.operators import sampling
    df = spark.range(4000).withColumn("c", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3))
    small = {(r.id, r.is_test) for r in stratified_split(df, "c", 0.2, 5, "id").collect()}
    monkeypatch.setattr(sampling, "RANKED", 0)
    assert {(r.id, r.is_test) for r in stratified_split(df, "c", 0.2, 5, "id").collect()} == small


def test_two_level_search_matches_window_form(spark):
    df = with_seeds(_frame(spark, 5000), [1, 2, 3])
    sp = stratified_split(df, "y", 0.2, F.col("seed"), "key", by=["seed"])  # default path
    w = Window.partitionBy("seed", "y").orderBy(hash_hex(F.col("seed"), "key"), "key")
    n = {r["y"]: r["count"] for r in _frame(spark, 5000).groupBy("y").count().collect()}
    quota = {y: sum(r["is_test"] for r in sp.where(f"seed = 1 AND y = {y}").collect()) for y in n}
    assert sum(quota.values()) == 1000
    a = sorted((r["seed"], r["key"], r["is_test"]) for r in sp.collect())
    b = sorted((r["seed"], r["key"], r["rn"] <= quota[r["y"]])
               for r in df.withColumn("rn", F.row_number().over(w)).collect())
    assert a == b
    sil = assign_silo(_frame(spark, 2003), 7, 5, "key")
    w = Window.orderBy(hash_hex(5, "key"), "key")
    ref = _frame(spark, 2003).withColumn("silo", F.ntile(7).over(w) - 1)
    assert sorted(map(tuple, sil.select("key", "silo").collect())) == \
        sorted(map(tuple, ref.select("key", "silo").collect()))
