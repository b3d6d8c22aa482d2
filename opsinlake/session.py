"""Session settings and size-checked helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and single-machine runs. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("opsinlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for files between the steps of a job: the session's
    ``spark.checkpoint.dir``. A session on one machine without one gets a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="opsinlake-")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for work that is heavy per row: a table read as fewer partitions than the session has cores is
    repartitioned. Larger tables are left as they are, so this never shuffles data that is already spread. Meant for plain
    table reads, whose partitions are known without running anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def attach(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join a side of few rows per key onto a table that may be concentrated on one key.

    The keyed side is copied to ``salts`` salt values and the big side is spread over them by ``spread``, so a key that
    owns most rows is still split over many tasks. Where Spark's own statistics say that the keyed side is small, it is
    broadcast and the salt costs nothing.
    """
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        .join(salted, keys + ["_salt"], how)
        .drop("_salt")
    )


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, blocks: int = 16) -> DataFrame:
    """Pairs of rows with equal ``keys`` and ``a < b`` (a column of each side), by an equi-join on keys and a pair of
    blocks: every row lies in one of ``blocks`` hashed blocks and meets each block once, so one key with many rows is
    dealt to blocks * (blocks + 1) / 2 places. The output is quadratic by its nature; no side is broadcast."""
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        own = F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
        both = df.withColumn("_own", own).withColumn("_other", every)
        return both.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})

    x = dealt(left, a).withColumnRenamed("_own", "_own_a").drop("_other")
    y = dealt(right, b).withColumnRenamed("_own", "_own_b").drop("_other")
    met = x.join(y, [*keys, "_i", "_j"]).where((F.col(a) < F.col(b)) & (F.least("_own_a", "_own_b") == F.col("_i")) & (F.greatest("_own_a", "_own_b") == F.col("_j")))
    return met.drop("_own_a", "_own_b", "_i", "_j")
