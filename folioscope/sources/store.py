"""The folder that driver and executors share, and tables that are written once into it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a single-process session without it gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when Python exits."""
    path = f"{shared_folder(spark)}/folioscope-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system; a session that has ended is no error."""
    context = spark.sparkContext
    if context._jsc is None or context._jvm is None:
        return
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """Writes a table to ``path`` and reads it back: a lost executor costs a read, not the work above."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(df: DataFrame, label: str) -> DataFrame:
    return kept(df, scratch_path(df.sparkSession, label))
