"""Grouped random forests (L2, K10, V3, V6): all groups of a sweep in the same jobs.

A group is one model to fit (a seed, a k, a site, ...), named by a column.
Features are cut into equal bins of [0, 1] (they are min-max scaled), so rows
that share bins and label are one *cell* with a count, whatever their number.

* Bagging: a row falls into one of BUCKETS by a hash of its key; each tree
  draws a Poisson-like weight for every bucket.  The table of rows is read once
  and summed to (group, cell, bucket) before any tree is made.
* Growing: a node is split at the bin with the largest sum of squared class
  weights over sides (the Gini gain), among the first sqrt(features) of its
  features that can split it, in an order drawn for the node.  A node of more
  than ``small`` cells is split by DataFrame aggregates over (group, tree,
  node, feature, bin), level by level; smaller ones are grown to their leaves
  in one pass, many trees at a time, level by level in numpy.  Both ways give
  the same trees, so a group or a node of any size needs bounded memory.
* Scoring: cells to be scored travel with the training cells (with no counts)
  and take the share of class 1 at their leaf, in millionths, so that sums
  over trees do not depend on their order.

All draws are integer hashes, so a forest can be repeated by SQL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from privtab.functions.hashing import hash_bucket, hash_hex
from privtab.session import small_table, stored

BINS, BUCKETS, TREES, DEPTH = 16, 64, 100, 12
#: Weight of a bucket in a tree, for sixteen equally likely draws (Poisson of mean 1, nearly).
DRAWS = (0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 2, 3)
PRIME = 2147483647
#: Leaf shares are whole numbers of this part.
UNIT = 1_000_000
#: Cells of a node that one task finishes; cells that a task holds at a time.
SMALL, HELD = 1 << 16, 1 << 18


def draw(seed, a, b):
    """A number below PRIME from three whole numbers; columns, arrays or ints."""
    x = (seed * 7919 + a * 104729 + b * 1299709 + 12345) % PRIME
    x = (x * x + 48271) % PRIME
    return (x * x + 16807) % PRIME


def bins_of(features: Sequence[str], bins: int = BINS) -> Column:
    """Bin of every feature; below 0, NULL and NaN in the first, from 1 on in the last."""
    def one(c):
        x = F.nanvl(F.col(c).cast("double"), F.lit(0.0))
        return F.coalesce(F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return F.array(*[one(c) for c in features])


def _picks(n_features: int) -> int:
    return max(1, int(n_features ** 0.5))


def bagged_cells(train: DataFrame, asked: DataFrame, features: Sequence[str], label: str, key: str, group: str,
                 balanced: Column, bins: int) -> DataFrame:
    """(group, seed, tree, bins, c0, c1, w0, w1, asked): bagged counts and class
    weights of training cells and, with counts 0, the cells to be scored.
    ``train`` and ``asked`` have columns ``group``, seed, trees."""
    rows = train.select(
        F.col(group).alias("grp"), F.col("seed").cast("long").alias("seed"), F.col("trees").cast("int").alias("trees"),
        balanced.alias("balanced"), bins_of(features, bins).alias("bins"), F.col(label).cast("int").alias("y"),
        (hash_bucket(F.substring(hash_hex(F.col("seed"), key), 15, 2), 2) % BUCKETS).alias("bucket"))
    counts = stored(rows.groupBy("grp", "seed", "trees", "balanced", "bins", "bucket").agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")), "forest-counts")
    sums = counts.groupBy("grp", "balanced").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    kinds = (F.col("t0") > 0).cast("int") + (F.col("t1") > 0).cast("int")

    def weight(n):
        even = F.try_divide((F.col("t0") + F.col("t1")).cast("double"), (kinds * F.col(n)).cast("double"))
        return F.when(F.col("balanced"), F.coalesce(even, F.lit(0.0))).otherwise(F.lit(1.0))

    weights = small_table(sums.select(F.col("grp").alias("g"), weight("t0").alias("w0"), weight("t1").alias("w1")), "weights")
    cell = ["grp", "seed", "trees", "bins"]
    held = counts.select(*cell, F.struct("bucket", "n0", "n1").alias("h"), F.lit(0).alias("asked"))
    wanted = (asked.select(F.col(group).alias("grp"), F.col("seed").cast("long").alias("seed"),
                           F.col("trees").cast("int").alias("trees"), bins_of(features, bins).alias("bins")).distinct()
              .select(*cell, F.lit(None).cast(held.schema["h"].dataType).alias("h"), F.lit(1).alias("asked")))
    # at most BUCKETS entries in a list
    each = held.unionByName(wanted).groupBy(*cell).agg(F.collect_list("h").alias("held"), F.max("asked").alias("asked"))
    kind = StructType([each.schema["grp"], *StructType.fromDDL(
        "seed long, tree int, bins array<int>, c0 long, c1 long, asked int").fields])
    cells = each.mapInArrow(_bagged(to_arrow_schema(kind)), kind)
    return (cells.join(weights, F.col("grp").eqNullSafe(F.col("g"))).drop("g")
            .withColumns({"node": F.lit(1).cast("long"), "depth": F.lit(0)}))


def _bagged(schema: pa.Schema):
    """A cell's counts by bucket to its counts in every tree: a matrix product
    with the trees' bucket weights.  Trees that miss an unasked cell are left out."""
    def run(batches):
        for batch in batches:
            held = batch.column("held")
            ends = held.offsets.to_numpy().astype(np.int64)
            bucket, n0, n1 = (held.values.field(k).to_numpy().astype(np.int64) for k in range(3))
            seeds, trees = batch.column("seed").to_numpy(), batch.column("trees").to_numpy()
            asked = batch.column("asked").to_numpy() == 1
            for seed, many in sorted(set(zip(seeds.tolist(), trees.tolist()))):
                w = np.asarray(DRAWS, float)[draw(seed, np.arange(many)[None, :], np.arange(BUCKETS)[:, None]) // 1024 % 16]
                mine = np.flatnonzero((seeds == seed) & (trees == many))
                step = max(1, (1 << 19) // max(many, 1))
                for k in range(0, len(mine), step):
                    rows = mine[k:k + step]
                    sizes = ends[rows + 1] - ends[rows]
                    at = np.repeat(ends[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    sums = []
                    for n in (n0, n1):
                        table = np.zeros((len(rows), BUCKETS))
                        table[np.repeat(np.arange(len(rows)), sizes), bucket[at]] = n[at]
                        sums.append((table @ w).astype(np.int64))
                    r, tree = np.nonzero(asked[rows][:, None] | (sums[0] + sums[1] > 0))
                    take = pa.array(rows[r])
                    made = [batch.column("grp").take(take), pa.array(np.full(len(r), seed)), pa.array(tree.astype(np.int32)),
                            batch.column("bins").take(take), pa.array(sums[0][r, tree]), pa.array(sums[1][r, tree]),
                            pa.array(asked[rows][r].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)

    return run


# ---- large nodes: one level of all of them by DataFrame aggregates ----------------------------------

_NODE = ["grp", "tree", "node"]


def _gain(l0: Column, l1: Column, r0: Column, r1: Column) -> Column:
    return (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)


def best_splits(cells: DataFrame, n_features: int) -> DataFrame:
    """(grp, tree, node, feature, cut) of every node of ``cells`` that can be
    split: bins up to ``cut`` go left."""
    keys = [*_NODE, "feature"]
    hist = (cells.select(*_NODE, "seed", "w0", "w1", "c0", "c1", F.posexplode("bins").alias("feature", "bin"))
            .groupBy(*keys, "bin").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.first("seed").alias("seed"),
                                       F.first("w0").alias("w0"), F.first("w1").alias("w1")))
    upto, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    cut = hist.withColumns({"l0": F.sum("c0").over(upto), "l1": F.sum("c1").over(upto),
                            "r0": F.sum("c0").over(whole), "r1": F.sum("c1").over(whole)})
    cut = cut.withColumns({"r0": F.col("r0") - F.col("l0"), "r1": F.col("r1") - F.col("l1")})
    mixed = (F.col("l0") + F.col("r0") > 0) & (F.col("l1") + F.col("r1") > 0)
    cut = cut.filter(mixed & (F.col("l0") + F.col("l1") > 0) & (F.col("r0") + F.col("r1") > 0))
    w0, w1 = F.col("w0"), F.col("w1")
    cut = cut.withColumn("gain", _gain(F.col("l0") * w0, F.col("l1") * w1, F.col("r0") * w0, F.col("r1") * w1))
    per = cut.groupBy(*keys, "seed").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("best"))
    order = draw(F.col("seed"), F.col("tree"), F.col("node") * 64 + F.col("feature"))
    turn = F.row_number().over(Window.partitionBy(*_NODE).orderBy(order, "feature"))
    return (per.withColumn("turn", turn).filter(F.col("turn") <= _picks(n_features))
            .groupBy(*_NODE).agg(F.max("best").alias("best"))
            .select(*_NODE, (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("cut")))


def share_of(c0: Column, c1: Column, w0: Column, w1: Column) -> Column:
    """Share of class 1 of a leaf in parts of UNIT; 0 where nothing is."""
    part = F.try_divide(c1 * w1, c0 * w0 + c1 * w1)
    return F.coalesce(F.floor(part * UNIT + 0.5), F.lit(0)).cast("long")


def _large_levels(cells: DataFrame, n_features: int, depth: int, small: int) -> tuple[DataFrame, list[DataFrame]]:
    """Split the nodes of more than ``small`` cells until there are none; the
    cells that remain, and (grp, bins, share) of scored cells at closed leaves."""
    closed = []
    for _ in range(depth + 1):
        large = cells.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n"), F.sum("c0").alias("s0"), F.sum("c1").alias("s1"))
        large = stored(large.filter(F.col("n") > small), "forest-large")
        if large.isEmpty():
            break
        named = large.select(*[F.col(c).alias(f"_{c}") for c in _NODE], "s0", "s1")
        same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node"))
        cells = cells.join(named, same, "left").drop("_grp", "_tree")
        here = F.col("_node").isNotNull()
        splits = best_splits(cells.filter(here), n_features)
        splits = splits.select(F.col("grp").alias("_grp"), F.col("tree").alias("_tree"), F.col("node").alias("_at"), "feature", "cut")
        same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_at"))
        routed = stored(cells.join(splits, same, "left"), "forest-cells")
        split = F.col("feature").isNotNull() & (F.col("depth") < depth)
        ended = here & ~split
        closed.append(routed.filter(ended & (F.col("asked") == 1)).select("grp", "bins", share_of(
            F.col("s0"), F.col("s1"), F.col("w0"), F.col("w1")).alias("share")))
        right = (F.element_at("bins", F.col("feature") + 1) > F.col("cut")).cast("long")
        cells = (routed.filter(~ended)
                 .withColumns({"node": F.when(split, F.col("node") * 2 + right).otherwise(F.col("node")),
                               "depth": F.col("depth") + split.cast("int")})
                 .drop("_grp", "_tree", "_node", "_at", "s0", "s1", "feature", "cut"))
    return cells, closed


# ---- small nodes: grown to the leaves, many at a time -------------------------------------------------


def grow(units, bins, c0, c1, seed, tree, node, depth, w0, w1, n_bins: int, most: int):
    """Yield (cells, units, nodes, feature, cut, sums) of leaves and splits of
    every level.  ``units`` numbers the start node of each cell; seed .. w1 are
    by unit; feature -1 marks leaves.  ``cells`` are those that rest at a leaf."""
    d = bins.shape[1]
    at = np.arange(len(units))  # cells still on their way
    unit_of, place = np.arange(len(seed)), units.copy()  # open node -> unit, cell -> open node
    node, depth = node.copy(), depth.copy()
    while len(unit_of):
        n = len(unit_of)
        t0 = np.bincount(place, c0[at], n)
        t1 = np.bincount(place, c1[at], n)
        gains, cuts = np.full((n, d), -np.inf), np.zeros((n, d), np.int64)
        a, b = w0[unit_of][:, None], w1[unit_of][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            for f in range(d):
                code = place * n_bins + bins[at, f]
                l0 = np.bincount(code, c0[at], n * n_bins).reshape(n, n_bins).cumsum(1)[:, :-1]
                l1 = np.bincount(code, c1[at], n * n_bins).reshape(n, n_bins).cumsum(1)[:, :-1]
                r0, r1 = t0[:, None] - l0, t1[:, None] - l1
                fine = (l0 + l1 > 0) & (r0 + r1 > 0)
                l0, l1, r0, r1 = l0 * a, l1 * b, r0 * a, r1 * b
                gain = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
                gain[~fine] = -np.inf
                cuts[:, f] = gain.argmax(1)
                gains[:, f] = gain[np.arange(n), cuts[:, f]]
        order = np.stack([draw(seed[unit_of], tree[unit_of], node * 64 + f) for f in range(d)], 1)
        order = np.where(np.isfinite(gains), order, PRIME + 1)
        turn = order.argsort(1, kind="stable").argsort(1, kind="stable")
        gains[turn >= _picks(d)] = -np.inf
        feature = gains.argmax(1)
        split = np.isfinite(gains.max(1)) & (t0 > 0) & (t1 > 0) & (depth < most)
        cut = cuts[np.arange(n), feature]
        rest = ~split[place]
        yield at[rest], place[rest], unit_of, node, np.where(split, feature, -1), cut, t0, t1
        at, place = at[~rest], place[~rest]
        number = np.cumsum(split) - 1
        right = bins[at, feature[place]] > cut[place]
        place = number[place] * 2 + right
        unit_of, depth = np.repeat(unit_of[split], 2), np.repeat(depth[split] + 1, 2)
        node = np.repeat(node[split] * 2, 2) + np.tile([0, 1], int(split.sum()))


def _held(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole nodes with about ``held`` cells."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= held:
            table = pa.Table.from_batches(kept)
            key = [table.column(c) for c in ("grp", "tree", "node")]
            last = [k[-1].as_py() for k in key]
            start = table.num_rows - 1
            while start and all(k[start - 1].as_py() == v for k, v in zip(key, last)):
                start -= 1
            if start:
                yield table.slice(0, start)
                kept, size = table.slice(start).to_batches(), table.num_rows - start
    if kept:
        yield pa.Table.from_batches(kept)


def _units(table: pa.Table):
    """Numbers of whole nodes in a sorted table, and their first rows."""
    first = np.zeros(table.num_rows, bool)
    first[:1] = True
    for c in ("grp", "tree", "node"):
        codes = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(first) - 1, np.flatnonzero(first)


def _columns(table: pa.Table):
    cols = {c: table.column(c).to_numpy() for c in ("seed", "tree", "node", "depth", "c0", "c1", "w0", "w1", "asked")}
    flat = table.column("bins").combine_chunks().flatten().to_numpy()
    return cols, flat.reshape(table.num_rows, -1).astype(np.int64)


def _share(t0, t1, w0, w1):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.floor(t1 * w1 / (t0 * w0 + t1 * w1) * UNIT + 0.5)).astype(np.int64)


def _grown(n_bins: int, most: int, held: int, nodes: bool):
    def run(batches):
        for table in _held(batches, held):
            if not table.num_rows:
                continue
            units, first = _units(table)
            c, bins = _columns(table)
            by = {k: c[k][first] for k in ("seed", "tree", "node", "depth", "w0", "w1")}
            steps = grow(units, bins, c["c0"], c["c1"], by["seed"], by["tree"].astype(np.int64), by["node"],
                         by["depth"], by["w0"], by["w1"], n_bins, most)
            for cells, place, unit_of, node, feature, cut, t0, t1 in steps:
                share = _share(t0, t1, by["w0"][unit_of], by["w1"][unit_of])
                if nodes:
                    yield pa.RecordBatch.from_arrays(
                        [table.column("grp").take(pa.array(first[unit_of])).combine_chunks(),
                         pa.array(by["tree"][unit_of], pa.int32()), pa.array(node), pa.array(feature, pa.int32()),
                         pa.array(cut, pa.int32()), pa.array(t0.astype(np.int64)), pa.array(t1.astype(np.int64)),
                         pa.array(share)], names=["grp", "tree", "node", "feature", "cut", "c0", "c1", "share"])
                else:
                    wanted = c["asked"][cells] == 1
                    rows = pa.array(cells[wanted])
                    yield pa.RecordBatch.from_arrays(
                        [table.column("grp").take(rows).combine_chunks(), table.column("bins").take(rows).combine_chunks(),
                         pa.array(share[place[wanted]])], names=["grp", "bins", "share"])

    return run


def _finish(cells: DataFrame, ddl: str, n_bins: int, most: int, held: int, nodes: bool) -> DataFrame:
    dealt = cells.repartition("grp", "tree", "node").sortWithinPartitions("grp", "tree", "node")
    kind = cells.schema["grp"].dataType.simpleString()
    return dealt.mapInArrow(_grown(n_bins, most, held, nodes), f"grp {kind}, {ddl}")


def _flag(balanced: bool | Column) -> Column:
    return balanced if isinstance(balanced, Column) else F.lit(balanced)


def forest_votes(train: DataFrame, asked: DataFrame, features: Sequence[str], label: str, key: str, group: str,
                 balanced: bool | Column = True, bins: int = BINS, depth: int = DEPTH, small: int = SMALL,
                 held: int = HELD) -> DataFrame:
    """Fit one forest per value of ``group`` on ``train`` and score the cells of
    ``asked``: (group, bins, votes), ``votes`` the sum over its trees of the
    share of class 1, in parts of UNIT.

    Both tables have the group, ``seed`` and ``trees`` (trees of the group's
    forest); ``balanced`` (one value in a group) weighs classes evenly; a group without training rows gives no votes.  Features are taken
    in [0, 1], labels 0 and 1 (rows of other labels count as neither)."""
    cells = bagged_cells(train, asked, features, label, key, group, _flag(balanced), bins)
    if small < bins ** min(len(features), 32):  # else no node can hold more cells than ``small``
        cells, closed = _large_levels(stored(cells, "forest-cells"), len(features), depth, small)
    else:
        closed = []
    found = _finish(cells, "bins array<int>, share long", bins, depth, held, False)
    for more in closed:
        found = found.unionByName(more)
    return found.groupBy("grp", "bins").agg(F.sum("share").alias("votes")).withColumnRenamed("grp", group)


def forest_nodes(train: DataFrame, features: Sequence[str], label: str, key: str, group: str,
                 balanced: bool | Column = True, bins: int = BINS, depth: int = DEPTH, held: int = HELD) -> DataFrame:
    """The trees themselves: (group, tree, node, feature, cut, c0, c1, share), a
    row a node; children of n are 2n and 2n + 1, feature -1 marks a leaf."""
    cells = bagged_cells(train, train.limit(0), features, label, key, group, _flag(balanced), bins)
    ddl = "tree int, node long, feature int, cut int, c0 long, c1 long, share long"
    return _finish(cells, ddl, bins, depth, held, True).withColumnRenamed("grp", group)


def label_rows(asked: DataFrame, votes: DataFrame, features: Sequence[str], by: Sequence[str], trees: Column,
               bins: int = BINS, out: str = "predicted") -> DataFrame:
    """L3: label 1 where the mean share over ``trees`` trees is at least one half;
    rows meet their cell's votes by ``by`` and bins, a stored table that is
    broadcast if small, so rows are not shuffled by cell."""
    named = small_table(votes.withColumnsRenamed({c: f"_{c}" for c in [*by, "bins"]}), "votes")
    rows = asked.withColumn("_cell", bins_of(features, bins))
    same = F.col("_cell") == F.col("_bins")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = rows.join(named, same, "left")
    return (met.withColumn(out, (F.col("votes") * 2 >= trees * UNIT).cast("int"))
            .drop("_cell", "votes", *[f"_{c}" for c in [*by, "bins"]]))
