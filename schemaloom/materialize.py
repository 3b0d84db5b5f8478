"""Shared scratch storage: cut lineage with files that every executor can reach.

Iterative operators need an intermediate result that survives the loss of an
executor.  They get it from the folder in ``spark.checkpoint.dir``; only a
session without that setting (a test on one machine) gets a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local master without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="schemaloom-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """:func:`materialize` and the number of rows, observed by the tasks that write them."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return written, seen.get["n"]


def discard(df: DataFrame) -> None:
    """Delete the files behind a result of :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
