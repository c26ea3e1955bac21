"""Materialise a result that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where it is unset, a private one, on a local master only."""
    folder = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="bookwise-")
    spark.conf.set(_CHECKPOINT_DIR, folder)
    return folder


def _own_folder(spark: SparkSession):
    """This application's part of the shared folder, with its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/bookwise/{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one result. The application's paths are deleted when it ends."""
    path, files = _own_folder(spark)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{path.toString()}/{name}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has staged so far; results read from it are gone."""
    path, files = _own_folder(spark)
    files.delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many.

    The written table survives the loss of executors, keeps its file sizes as
    statistics (so joins against it are sized correctly) and is column-pruned by
    each reader, which exchange reuse is not. It lives until the application ends or
    calls ``clear_stages``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
