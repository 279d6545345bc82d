"""The folder that driver and executors share, for tables of intermediate steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``, as a whole
    URI: Spark makes it with its own file system, so a path without a scheme is
    taken as Spark takes it.

    Where the setting is missing a temporary folder serves on a local master,
    as in tests. On a cluster machines share no disk, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = "file://" + tempfile.mkdtemp(prefix="gaugeflow-")
        context.setCheckpointDir(at)
    return re.sub(r"^file:/(?!/)", "file:///", context.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems have the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders with Spark's own file systems."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = hadoop(p)
        path.getFileSystem(conf).delete(path, True)


def once(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once, into a table of the shared folder that stays with
    the application: for frames that several results read."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
