"""Where intermediate tables go: the folder that all executors share.

Only a session in one process (``local[n]``, as in tests) may leave that folder
unset; a machine-local one is used then.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which must be set: executors and driver read each other's files there."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quillspan-"))
        return f"file://{_own[0]}"
    raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")


_own: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's switch that deletes a query's shuffle files as soon as the query has ended, whoever still refers to its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there, and lost executors cost nothing of it.

    With ``clean`` the shuffle files of the step are gone when it has been written.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop(settled: DataFrame) -> None:
    """Delete a settled table that nothing reads any more, through Hadoop's file system (it may be remote)."""
    spark = settled.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(settled._settled)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Let go of shuffle files of finished steps: Spark deletes them when the driver's objects for them are collected."""
    gc.collect()
    spark._jvm.System.gc()
