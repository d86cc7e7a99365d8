"""Grouped forests: both ways of growing agree with a plain recursive tree."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from privtab.functions.hashing import hash_bucket, hash_hex
from privtab.operators import forest as FO

FEATS = ["a", "b", "c"]


def plain_tree(cells, seed, tree, w, depth, node=1, level=0):
    """{leaf node: (cells, share)} by recursion over dicts; ``cells``: bins -> (c0, c1)."""
    t0, t1 = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
    found = {}
    if t0 and t1 and level < depth:
        for f in range(3):
            for cut in sorted({b[f] for b in cells})[:-1] if cells else []:
                left = [c for b, c in cells.items() if b[f] <= cut]
                l0, l1 = sum(c[0] for c in left), sum(c[1] for c in left)
                if l0 + l1 and t0 + t1 - l0 - l1:
                    x0, x1, y0, y1 = l0 * w[0], l1 * w[1], (t0 - l0) * w[0], (t1 - l1) * w[1]
                    gain = (x0 * x0 + x1 * x1) / (x0 + x1) + (y0 * y0 + y1 * y1) / (y0 + y1)
                    if f not in found or gain > found[f][0]:
                        found[f] = (gain, cut)
    if not found:
        total = t0 * w[0] + t1 * w[1]
        return {node: (list(cells), int(t1 * w[1] / total * FO.UNIT + 0.5) if total else 0)}
    f = min(found, key=lambda f: FO.draw(seed, tree, node * 64 + f))  # sqrt(3) is one feature
    cut = found[f][1]
    out = {}
    for side in (0, 1):
        part = {b: c for b, c in cells.items() if (b[f] > cut) == bool(side)}
        out.update(plain_tree(part, seed, tree, w, depth, 2 * node + side, level + 1))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = []
    for g, seed in (("x", 42), ("y", 7), (None, 42)):
        for i in range(260 if g != "y" else 40):
            a, b, c = rng.random(), rng.choice((0.0, 0.3, 1.0)), rng.choice((None, 0.2, 0.9, 1.4, -1.0, float("nan")))
            rows.append((g, seed, 4, i, a, b, c, int(a + b * rng.random() > 0.8), i % 5 == 0))
    rows += [("one", 1, 4, i, 0.5, 0.5, 0.5, 1, i == 0) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, seed long, trees int, id long, a double, b double, c double, y int, is_test boolean")
    return df.where("NOT is_test"), df.where("is_test")


def brute(spark, train, test, balanced, depth, bins):
    def keyed(df):
        bucket = hash_bucket(F.substring(hash_hex(F.col("seed"), "id"), 15, 2), 2) % FO.BUCKETS
        return df.select("g", "seed", "trees", "y", bucket.alias("bucket"), FO.bins_of(FEATS, bins).alias("bins")).collect()
    rows, asked, out = keyed(train), keyed(test), Counter()
    for g in {r.g for r in rows}:
        mine = [r for r in rows if r.g == g]
        n = [sum(r.y == k for r in mine) for k in (0, 1)]
        w = [len(mine) / (sum(map(bool, n)) * k) if k else 0.0 for k in n] if balanced else [1.0, 1.0]
        for tree in range(mine[0].trees):
            cells = {tuple(r.bins): [0, 0] for r in asked if r.g == g}
            for r in mine:
                many = FO.DRAWS[FO.draw(r.seed, tree, r.bucket) // 1024 % 16]
                if many:
                    cells.setdefault(tuple(r.bins), [0, 0])[r.y] += many
            for bins_, share in plain_tree(cells, mine[0].seed, tree, w, depth).values():
                for b in bins_:
                    if any(tuple(r.bins) == b and r.g == g for r in asked):
                        out[g, b] += share
    return dict(out)


@pytest.mark.parametrize("balanced,depth,small,held", [(True, 12, FO.SMALL, FO.HELD), (False, 3, FO.SMALL, 50),
                                                        (True, 5, 20, 100)])
def test_votes_equal_a_plain_tree(spark, tables, balanced, depth, small, held):
    train, test = tables
    got = FO.forest_votes(train, test, FEATS, "y", "id", "g", balanced, 8, depth, small, held).collect()
    got = {(r.g, tuple(r.bins)): r.votes for r in got}
    want = brute(spark, train, test, balanced, depth, 8)
    assert got == {k: want.get(k, 0) for k in got} and set(want) <= set(got)


def test_nodes_and_labels(spark, tables):
    train, test = tables
    nodes = FO.forest_nodes(train, FEATS, "y", "id", "g", bins=8, depth=4).collect()
    by = {(r.g, r.tree, r.node): r for r in nodes}
    for (g, tree, node), r in by.items():
        if r.feature >= 0:
            kids = [by[g, tree, 2 * node + s] for s in (0, 1)]
            assert (r.c0, r.c1) == tuple(sum(x) for x in zip(*[(k.c0, k.c1) for k in kids]))
        assert node < 2 ** 5
    votes = FO.forest_votes(train, test, FEATS, "y", "id", "g", bins=8, depth=4)
    rows = FO.label_rows(test, votes, FEATS, ["g"], F.col("trees"), 8).collect()
    assert len(rows) == test.count() and all(r.predicted in (0, 1) for r in rows)
    right = [r.predicted == r.y for r in rows if r.g in ("x", "one")]
    assert sum(right) / len(right) > 0.8


def test_no_rows(spark, tables):
    train, test = tables
    assert FO.forest_votes(train.limit(0), test, FEATS, "y", "id", "g").collect() == []


def test_sites_are_asked_for_cells_not_rows(spark, monkeypatch):
    """Test rows are one per cell before they meet their federation's sites; votes are broadcast."""
    from privtab.operators import forest, silo
    x = spark.range(400).select(F.col("id"), F.lit("f").alias("fed"), F.concat(F.lit("s"), (F.col("id") >= 200).cast("int")).alias("site"), F.lit(1).alias("seed"),
                                (F.col("id") % 10 / 10).alias("a"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    odd = spark.createDataFrame([(-1.0,), (2.0,), (None,), (float("nan"),)], "a double").withColumns({"id": F.lit(0).cast("long"), "fed": F.lit("f")})
    test = x.select("id", "fed", "a").unionByName(odd)
    asked = []

    def votes(train, each, *args):
        asked.append(each.count())
        return forest.forest_votes(train, each, *args)

    monkeypatch.setattr(silo, "forest_votes", votes)
    out = silo.rf_by_silo(x, test, ["a"], "y", "id", "fed", 5, silo="site", bins=10)
    assert asked == [20]  # 10 cells x 2 sites; 404 rows x 2 before
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = out.collect()
    assert len(got) == 404 and all(r.predicted == int(r.a is not None and r.a == r.a and r.a > 0.45) for r in got)
