"""Tables written between the steps of one operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only where none is set in a session on one machine (as in tests) a new
    temporary folder becomes the checkpoint folder; on a cluster executors could not read each other's files there, so that is an
    error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write a step as Parquet and read it back: lost executors cost no recomputation of what came before, and the
    following joins are planned with the true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, rows: int, known: int | None = None) -> DataFrame:
    """The ``rows`` rows with the smallest hash of doc_id. Rows are first cut to about twice as many by a threshold on the
    hash, from the count of the table (``known``), so that tasks do not each send ``rows`` rows to the last sort."""
    key, top = F.pmod(F.xxhash64("doc_id"), F.lit(2**62)), 2**62
    threshold = min(top, int(2 * rows / max(df.count() if known is None else known, 1) * top))
    return df.where(key < F.lit(threshold)).orderBy(key, "doc_id").limit(rows)
