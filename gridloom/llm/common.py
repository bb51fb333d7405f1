"""What the operators share: the shared folder, written intermediate tables and text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and the controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset a local session gets a temporary folder; a cluster has no use for one, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    fs.deleteOnExit(path)
    return path.toString()


#: Paths of the tables written so far, of which some are gone.
_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so later steps don't depend on lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_path)


@contextmanager
def temporary(spark: SparkSession):
    """Tables materialised within are deleted at the end, but those appended to the list that it gives."""
    begun, kept = len(_written), []
    yield kept
    stay = [t.written_path for t in kept]
    for path in _written[begun:]:
        if path not in stay:
            _delete(spark, path)
    _written[begun:] = stay


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be very long.

    Spark reads the limits when a plan runs, so they must outlast the call.  All operators ask for the same ones, and a session's own
    smaller ones stay; so no operator changes what another one runs with.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        now = int(now) if now and str(now).isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)
