"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "privtab") -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session already exists (spark-submit); its settings are
    left untouched.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("PRIVTAB_MASTER", "local[8]"))
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or 8))
    builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder for cut lineage (``spark.checkpoint.dir``).

    A cluster names it in its configuration; only when it is unset (local
    tests) do we create a private scratch folder.  Without a SparkContext
    (Spark Connect) the server's configuration decides and None is returned.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return configured
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="privtab-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder; Spark's file system
    removes the folder when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and return the
    re-read frame.  Survives lost executors, keeps column pruning and pushed
    filters, and gives later plans the table's real size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """``stored``, where one derived table (e.g. a seeded split cohort) feeds
    many jobs: iterative fits, several evaluations."""
    return stored(df, "rows")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the shuffle partitions: for a table that comes in
    few files and is about to be repeated many times (per seed, setting, k)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Largest stored table (bytes on disk) that is sent to every executor.
BROADCAST_BYTES = 8 << 20


def small_table(df: DataFrame, name: str = "small") -> DataFrame:
    """``stored``, with a broadcast hint only if what was written is at most
    BROADCAST_BYTES; beyond it joins are left to the engine."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(out) if fs.getContentSummary(where).getLength() <= BROADCAST_BYTES else out
