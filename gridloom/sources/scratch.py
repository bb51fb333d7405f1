"""Temporary tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, deleted when the driver ends.

    Where that is unset a local session gets a temporary folder; a cluster has no use for one, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/gridloom/{label}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written and read back: what follows doesn't depend on what came before."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """The path of a file in a mounted folder; flat files need one that every executor mounts."""
    if "://" in path.replace("file://", ""):
        raise ValueError(f"{path} isn't in a mounted folder")
    return path.removeprefix("file://").removeprefix("file:")
