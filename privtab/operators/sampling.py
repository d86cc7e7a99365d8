"""Exact, seeded sampling, stratified splits and site assignment.

All three are "rank the rows by md5(seed:key) inside a group and cut the
ranking at given positions".  A window ordered over a whole group would put
every row of a class (or of the table) into one task, so the rows at the cut
positions are found first, in tables whose size does not depend on the rows:

1. rows are counted per (group, first three hash digits); bucket offsets (a
   window over that small table) say which bucket holds each cut;
2. if such a bucket holds more than RANKED rows, its rows are counted by the
   next three digits too, which leaves about n / 16^6 rows per cut;
3. the rows of those buckets are ranked, each bucket in a window partition of
   its own; the row at the cut is its exact (hash, key);
4. every row is labelled by comparing its (hash, key) with its group's cuts:
   no window, and no shuffle of rows while the stored table of cuts is at most
   the broadcast limit (``small_table``).

So the input is read three times, or four times with large buckets.  Nothing
comes to the driver but one number, the size of the largest bucket.  Groups
match null-safely, so a NULL class or group is a group like any other.  A cut
that falls between two rows of one key cannot be made and is refused: the key
must tell rows of a group apart.

The result equals ``row_number() OVER (PARTITION BY group ORDER BY hash, key)``
compared with the cuts, which is what the SQL oracles use.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privtab.functions.hashing import hash_hex
from privtab.session import small_table, stored

CutFn = Callable[[DataFrame], DataFrame]

#: Hash digits of each of the two counting levels (16^3 buckets).
LEVEL_DIGITS = 3
#: Rows of a bucket that one window partition ranks.
RANKED = 1 << 18


def _join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``cols``, which the result has once."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in cols})
    cond = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in cols]
    return left.join(renamed, cond, how).drop(*[f"_right_{c}" for c in cols])


def _locate(counts: DataFrame, cuts: DataFrame, by: Sequence[str], bucket: str) -> DataFrame:
    """The bucket that holds each cut ``_c`` (a rank within ``by``), with the
    cut's rank inside the bucket."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_bn").over(w), F.lit(0)))
    return (_join(offsets, cuts, by)
            .where((F.col("_c") > F.col("_off")) & (F.col("_c") <= F.col("_off") + F.col("_bn")))
            .select(*by, bucket, (F.col("_c") - F.col("_off")).alias("_c"), "_bn"))


def _buckets(at: DataFrame, level: Sequence[str]) -> DataFrame:
    """The buckets that hold cuts, each once: no more rows than cuts, so the
    hint that the table of cuts has or has not holds for them as well."""
    one = Window.partitionBy(*level).orderBy("_c")
    out = at.withColumn("_first", F.row_number().over(one) == 1).where("_first").select(*level)
    return small_table(out, "buckets")


def rank_cut(df: DataFrame, key: str, seed, by: Sequence[str], cuts: CutFn,
             out: str = "part") -> DataFrame:
    """Label each row with the number of cut positions below its rank.

    ``cuts(totals)`` receives one row per group (``by`` columns and ``_n``, the
    group's row count) and returns ``by`` columns plus ``_cuts``
    (array<bigint>, 1-based rank positions).  A row of rank r gets
    ``#{c in _cuts : c < r}``.
    """
    by = list(by)
    helpers = ["_h", "_points", "_low"]
    if not by:
        df, by = df.withColumn("_g", F.lit(0)), ["_g"]
        helpers.append("_g")
    rows = df.withColumn("_h", hash_hex(seed, key))
    slim = rows.select(*by, "_h", F.col(key).alias("_k"),
                       F.substring("_h", 1, LEVEL_DIGITS).alias("_b1"),
                       F.substring("_h", 1 + LEVEL_DIGITS, LEVEL_DIGITS).alias("_b2"))
    # groups x 4096 rows at most, read by the totals and by the search
    coarse = stored(slim.groupBy(*by, "_b1").agg(F.count(F.lit(1)).alias("_bn")), "cut-counts")
    totals = coarse.groupBy(*by).agg(F.sum("_bn").alias("_n"))
    wanted = cuts(totals).select(*by, F.explode("_cuts").alias("_c"))
    level = [*by, "_b1"]
    at = small_table(_locate(coarse, wanted, by, "_b1"), "cuts")
    if (at.agg(F.max("_bn")).first()[0] or 0) > RANKED:
        fine = (_join(slim, _buckets(at, level), level)
                .groupBy(*level, "_b2").agg(F.count(F.lit(1)).alias("_bn")))
        at, level = small_table(_locate(fine, at.drop("_bn"), level, "_b2"), "cuts"), [*level, "_b2"]
    order = Window.partitionBy(*level).orderBy("_h", "_k")
    ranked = (_join(slim, _buckets(at, level), level)
              .withColumn("_rn", F.row_number().over(order))
              .withColumn("_same", F.lead("_k").over(order).eqNullSafe(F.col("_k"))
                          & (F.lead("_h").over(order) == F.col("_h"))))
    point = F.struct("_h", F.when(F.col("_same"), F.raise_error(F.lit(f"key {key} is not unique at a cut")))
                     .otherwise(F.col("_k")).alias("_k"))
    points = (_join(ranked, at.drop("_bn"), level).where(F.col("_rn") == F.col("_c"))
              .groupBy(*by).agg(F.collect_list(point).alias("_points")))
    low = wanted.groupBy(*by).agg(F.count_if(F.col("_c") <= 0).alias("_low"))
    labelled = _join(rows, small_table(_join(low, points, by, "left"), "cut-points"), by, "left")
    above = F.size(F.filter(F.coalesce("_points", F.array()), lambda x: (x["_h"] < F.col("_h"))
                            | ((x["_h"] == F.col("_h")) & (x["_k"] < F.col(key)))))
    return labelled.withColumn(out, (F.coalesce("_low", F.lit(0)) + above).cast("int")).drop(*helpers)


def sample_exact(df: DataFrame, n: int, seed: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` rows per group without replacement (all rows when the
    group is not larger than ``n``): the ``n`` smallest md5(seed:key)."""
    def cuts(totals: DataFrame) -> DataFrame:
        return totals.withColumn(
            "_cuts", F.when(F.col("_n") > n, F.array(F.lit(n).cast("bigint")))
                      .otherwise(F.array().cast("array<bigint>")))
    labelled = rank_cut(df, key, seed, by, cuts, out="_part")
    return labelled.where(F.col("_part") == 0).drop("_part")


def stratified_split(df: DataFrame, target: str, test_size: float, seed, key: str,
                     by: Sequence[str] = (), out: str = "is_test",
    ) -> DataFrame:
    """E5: seeded stratified split; adds boolean ``out`` (True = test row).

    Test size is ``ceil(test_size * n)`` (double arithmetic, as the usual
    scikit-learn rule); class c gets ``floor(n_test * n_c / n)`` test rows and
    the remaining rows go one each to the classes with the largest remainders
    (ties: smaller class value first).  Inside a class the test rows are the
    ones with the smallest md5(seed:key).  ``seed`` may be an int or a column
    (one job for many seeds: put the seed column in ``by``).
    """
    by = list(by)

    def cuts(totals: DataFrame) -> DataFrame:
        g = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        t = (totals.withColumn("_tot", F.sum("_n").over(g))
             .withColumn("_nt", F.ceil(F.lit(float(test_size)) * F.col("_tot")).cast("bigint"))
             # exact integer arithmetic (decimal avoids bigint overflow at scale)
             .withColumn("_q", F.expr("(cast(_nt as decimal(38,0)) * _n) div _tot").cast("bigint"))
             .withColumn("_rem", F.expr("pmod(cast(_nt as decimal(38,0)) * _n, _tot)"))
             .withColumn("_short", F.col("_nt") - F.sum("_q").over(g)))
        order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))) \
            .orderBy(F.col("_rem").desc(), F.col(target).asc())
        t = t.withColumn("_q", F.col("_q") + F.when(F.row_number().over(order) <= F.col("_short"), 1)
                         .otherwise(0))
        return t.withColumn("_cuts", F.array(F.col("_q").cast("bigint")))

    labelled = rank_cut(df, key, seed, by + [target], cuts, out="_part")
    return labelled.withColumn(out, F.col("_part") == 0).drop("_part")


def assign_silo(df: DataFrame, n_sites, seed, key: str, by: Sequence[str] = (),
                out: str = "silo") -> DataFrame:
    """Contiguous near-equal split of the hash order into ``n_sites``
    parts (0-based); the first ``n % n_sites`` parts get one row more — the
    same sizes as SQL ``ntile``.  ``n_sites`` may be an int or a column."""
    p = n_sites if isinstance(n_sites, Column) else F.lit(int(n_sites))

    def cuts(totals: DataFrame) -> DataFrame:
        q = F.floor(F.col("_n") / p).cast("bigint")
        r = F.pmod(F.col("_n"), p).cast("bigint")
        seq = F.when(p > 1, F.sequence(F.lit(1).cast("bigint"), (p - 1).cast("bigint")))
        arr = F.transform(seq, lambda i: i * q + F.least(i, r))
        return totals.withColumn(
            "_cuts", F.coalesce(arr, F.array().cast("array<bigint>")))

    return rank_cut(df, key, seed, by, cuts, out=out)


def with_seeds(df: DataFrame, seeds: Sequence[int], col: str = "seed") -> DataFrame:
    """Repeat every row once per seed (a generator, not a join)."""
    return df.withColumn(col, F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
