import tempfile

import pytest

from privtab.sources import accepted, existing, read_first, read_table, refused, resolve_target, write_table


def test_roundtrip_and_first_existing(spark):
    out = tempfile.mkdtemp(prefix="privtab-test-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    write_table(df, f"{out}/t.csv", fmt="csv", single_file=True)
    back = read_first(spark, [f"{out}/missing.csv", f"{out}/t.csv"], fmt="csv")
    assert sorted(r["v"] for r in back.collect()) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        read_first(spark, [f"{out}/nope1.csv", f"{out}/nope2.csv"], fmt="csv")


def test_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, hosp_yn int")
    assert existing(df, ["x", "a"]) == ["a"]
    assert resolve_target(df, ["death_yn", "hosp_yn"]) == "hosp_yn"
    with pytest.raises(ValueError):
        resolve_target(df, ["death_yn"])


ALL = ("i int, l long, d double, dec decimal(20,4), b boolean, day date, ts timestamp, s string")


def test_csv_round_trip_of_every_type(spark, tmp_path):
    from datetime import date, datetime
    from decimal import Decimal
    rows = [(1, -2**63, 0.1, Decimal("12345678901234.5678"), True, date(1999, 12, 31), datetime(2020, 1, 2, 3, 4, 5, 678901), "plain"),
            (2, 2**63 - 1, 1e-300, Decimal("-0.0001"), False, date(2024, 2, 29), datetime(1970, 1, 1), 'a "quoted", text'),
            (None,) * 8, (3, 0, float("inf"), Decimal(0), None, None, None, "  blanks  "), (4, 0, float("-inf"), None, None, None, None, ""),
            (5, 0, -0.0, None, None, None, None, "é 日本 \\ back"), (6, 0, 1.5, None, None, None, None, "'single' # ; |")]
    df = spark.createDataFrame(rows, ALL)
    write_table(df, f"{tmp_path}/t.csv", fmt="csv")
    back = read_table(spark, f"{tmp_path}/t.csv", schema=df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    lines = spark.createDataFrame([(1, "two\nlines"), (2, "x")], "i int, s string")
    write_table(lines, f"{tmp_path}/m.csv", fmt="csv", single_file=True)
    assert sorted(map(tuple, read_table(spark, f"{tmp_path}/m.csv", schema=lines.schema, multi_line=True).collect())) == [
        (1, "two\nlines"), (2, "x")]


def test_typed_csv_with_rows_that_do_not_fit(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,x,name\n1,0.5,a\n2,NaN,"b, c"\nthree,1.0,d\n4,,\n5,oops,e\n6,1,f,7\n')
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("id long, x double, name string")
    df = read_table(spark, f"{tmp_path}/t.csv", schema=schema, corrupt="_bad")
    assert sorted(map(tuple, accepted(df, "_bad").collect())) == [(1, 0.5, "a"), (2, None, "b, c"), (4, None, None)]
    assert sorted(r["_bad"] for r in refused(df, "_bad").collect()) == ["5,oops,e", "6,1,f,7", "three,1.0,d"]
    assert sorted(r["id"] or 0 for r in refused(df, "_bad").collect()) == [0, 5, 6]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, f"{tmp_path}/t.csv", schema=schema).collect()
    with pytest.raises(ValueError):
        read_table(spark, f"{tmp_path}/t.csv", schema=schema, corrupt="x")


def test_nan_is_null_at_ingest(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 1.0)], "i int, x double").write.parquet(f"{tmp_path}/t.parquet")
    assert sorted(r.x or 0 for r in read_table(spark, f"{tmp_path}/t.parquet").collect()) == [0, 1.0]
    kept = read_table(spark, f"{tmp_path}/t.parquet", keep_nan=True)
    assert sum(r.x != r.x for r in kept.collect()) == 1
