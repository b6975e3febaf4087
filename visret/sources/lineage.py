"""Cutting lineage in the shared folder that spark.checkpoint.dir names."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the session names none, one of our own if
    all runs on this machine, as in tests; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="visret-"))
    return named or spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A name for a folder in the shared one, which nothing has yet."""
    return f"{shared_folder(spark)}/visret-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that several uses do not compute it
    again and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def located(spark: SparkSession, path: str):
    """(file system, path) as Spark sees them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = located(spark, path)
    return files.exists(there)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    files, there = located(spark, path)
    files.create(there, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    files, there = located(spark, path)
    files.delete(there, True)
