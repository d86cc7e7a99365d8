"""Scoring hidden features with additive secret sharing (M1, M2).

The reference scores encrypted rows one by one.  Here the features are
split into two share tables held by non-colluding parties; each party
computes a linear score of its shares by itself (a projection, fully
parallel), and only the two per-row share scores are combined:

* fixed point: features and weights are scaled by 2^20 and rounded;
* shares: ``A_j = r_j`` and ``B_j = (X_j - r_j) mod P`` with P = 2^61 - 1
  and ``r_j`` 64 hash bits mod P (uniform to within 2^-61 of each value);
* each party: ``S = (Σ W_j * share_j) mod P`` in ``decimal(38,0)``;
* recombine: ``(S_A + S_B) mod P``, centred to a signed value, divided by
  2^40, plus the bias, then sigmoid and threshold.

The recombined score equals the plain fixed-point score exactly; a row whose
score could leave the range of the modulus is refused (``checked``).  With
``seed=None`` the masks are keyed SHA-256 values under a secret salt from
the operating system; an int seed gives md5 masks that tests can replay.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privtab.functions.exprs import sigmoid, threshold
from privtab.functions.hashing import hash_hex
from privtab.session import scratch

MODULUS = 2 ** 61 - 1
FRAC_BITS = 20
DEC = "decimal(38,0)"


def fixed_point(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") * F.lit(float(2 ** FRAC_BITS))).cast(DEC)


def fixed_weight(w: float) -> int:
    return int(round(w * 2 ** FRAC_BITS))


def _mask(seed, key: str, j: int) -> Column:
    if isinstance(seed, str):  # secret salt: keyed SHA-256
        h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.lit(str(j))), 256)
    else:  # replayable draw for tests
        h = hash_hex(seed, key, F.lit(j))
    return F.pmod(F.conv(F.substring(h, 1, 16), 16, 10).cast(DEC), F.lit(MODULUS).cast(DEC))


def checked(df: DataFrame, cols: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Refuse a row with ``Σ |W_j X_j| >= 2^60``: its score would wrap around."""
    bound = F.lit(0.0)
    for c, w in zip(cols, weights):
        bound = bound + F.coalesce(F.abs(F.col(c).cast("double")), F.lit(0.0)) * F.lit(float(abs(fixed_weight(w))))
    fits = bound * F.lit(float(2 ** FRAC_BITS)) < F.lit(float(2 ** 60))
    first = cols[0]
    return df.withColumn(first, F.when(fits, F.col(first)).otherwise(
        F.raise_error(F.lit("score out of range: scale the features first"))))


def share(df: DataFrame, cols: Sequence[str], key: str, seed: int | None = None
          ) -> tuple[DataFrame, DataFrame]:
    """M1: two share tables (key, s_0..s_{d-1}); either alone is uniform noise.

    ``seed=None`` draws a 256-bit secret salt from the operating system and
    derives the masks as keyed SHA-256 values (nobody without the salt can
    recompute them); an int seed gives replayable md5 masks for tests."""
    salt = secrets.token_hex(32) if seed is None else seed
    p = F.lit(MODULUS).cast(DEC)
    a = df.select(key, *[_mask(salt, key, j).alias(f"s_{j}") for j in range(len(cols))])
    b = df.select(key, *[F.pmod(fixed_point(c) - _mask(salt, key, j), p).alias(f"s_{j}")
                         for j, c in enumerate(cols)])
    return a, b


def share_tables(df: DataFrame, cols: Sequence[str], key: str, seed: int | None = None,
                 buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M1: ``share`` as stored tables, one folder a party, bucketed by key.

    The features are scanned and shuffled once, when the tables are written;
    any number of scorings then joins the two parties' scores bucket with
    bucket, without another shuffle.  ``buckets`` is the session's number of
    shuffle partitions by default.  Bucketing is a property of a catalog table:
    the name stays in the session's catalog until ``drop_shares``."""
    spark = df.sparkSession
    salt = secrets.token_hex(32) if seed is None else seed
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = F.lit(MODULUS).cast(DEC)
    fixed = df.select(key, *[fixed_point(c).alias(f"x_{j}") for j, c in enumerate(cols)])
    masked = fixed.repartition(buckets, key).select(
        "*", *[_mask(salt, key, j).alias(f"r_{j}") for j in range(len(cols))])
    names = [f"s_{j}" for j in range(len(cols))]
    parties = F.array(
        F.struct(F.lit("a").alias("party"), *[F.col(f"r_{j}").cast("bigint").alias(n) for j, n in enumerate(names)]),
        F.struct(F.lit("b").alias("party"), *[F.pmod(F.col(f"x_{j}") - F.col(f"r_{j}"), p).cast("bigint").alias(n)
                                              for j, n in enumerate(names)]))
    table = f"privtab_shares_{uuid.uuid4().hex}"
    (masked.select(F.col(key), F.explode(parties).alias("row")).select(key, "row.*")
     .write.format("parquet").option("path", scratch(spark, "shares")).partitionBy("party")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    a, b = (spark.table(table).where(F.col("party") == party).select(key, *names) for party in "ab")
    return a, b


def drop_shares(spark) -> int:
    """Take the tables of ``share_tables`` out of the catalog; how many there were."""
    names = [r["tableName"] for r in spark.sql("SHOW TABLES LIKE 'privtab_shares_*'").collect()]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(names)


def score_share(sh: DataFrame, weights: Sequence[float], key: str,
                out: str = "share_score") -> DataFrame:
    """M1: one party's score of its own shares, ``(Σ W_j s_j) mod P``."""
    p = F.lit(MODULUS).cast(DEC)
    total = F.lit(0).cast(DEC)
    for j, w in enumerate(weights):
        total = total + F.col(f"s_{j}").cast(DEC) * F.lit(fixed_weight(w)).cast(DEC)
    return sh.select(key, F.pmod(total, p).cast("bigint").alias(out))


def _to_score(t: Column, bias: float) -> Column:
    p = F.lit(MODULUS).cast(DEC)
    centred = F.when(t > F.lit(MODULUS // 2).cast(DEC), t - p).otherwise(t)
    return centred.cast("double") / F.lit(float(2 ** (2 * FRAC_BITS))) + F.lit(float(bias))


def recombine(score_a: DataFrame, score_b: DataFrame, key: str, bias: float,
              a: str = "share_score", b: str = "share_score") -> DataFrame:
    """M1: join the two share scores by key, unmask, sigmoid, threshold."""
    p = F.lit(MODULUS).cast(DEC)
    j = score_a.select(key, F.col(a).alias("score_a")).join(
        score_b.select(key, F.col(b).alias("score_b")), key)
    t = F.pmod(F.col("score_a").cast(DEC) + F.col("score_b").cast(DEC), p)
    j = j.withColumn("score", _to_score(t, bias))
    j = j.withColumn("prob", sigmoid(F.col("score")))
    return j.withColumn("label", threshold(F.col("prob")))


def plain_fixed_score(df: DataFrame, cols: Sequence[str], weights: Sequence[float],
                      bias: float, key: str) -> DataFrame:
    """The same score computed in the clear on the same fixed-point input."""
    total = F.lit(0).cast(DEC)
    for c, w in zip(cols, weights):
        total = total + fixed_point(c) * F.lit(fixed_weight(w)).cast(DEC)
    out = df.select(key, _to_score(total, bias).alias("score"))
    out = out.withColumn("prob", sigmoid(F.col("score")))
    return out.withColumn("label", threshold(F.col("prob")))


def hidden_score(df: DataFrame, cols: Sequence[str], weights: Sequence[float], bias: float,
                 key: str, seed: int | None = None) -> DataFrame:
    """M1 end to end: share, score each share table, recombine."""
    a, b = share(checked(df, cols, weights), cols, key, seed)
    return recombine(score_share(a, weights, key), score_share(b, weights, key), key, bias)


def weights_of(model_weights: Mapping[str, float], cols: Sequence[str]) -> list[float]:
    return [float(model_weights[c]) for c in cols]
