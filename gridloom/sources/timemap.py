"""A raster of times that grow evenly from the first row to the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def linear_timemap(spark: SparkSession, width: int, height: int, start: float, end: float) -> DataFrame:
    """row, col, idx, t (32 bits)."""
    if width <= 0 or height <= 0:
        raise ValueError("width and height must be above 0")
    step = F.lit((end - start) / (height - 1) if height > 1 else 0.0)
    w = F.lit(width).cast("long")
    cells = spark.range(width * height).select(F.floor(F.col("id") / w).cast("int").alias("row"), F.pmod("id", w).cast("int").alias("col"), F.col("id").alias("idx"))
    t = F.col("row") * step + F.lit(float(start))
    last = F.when(F.col("row") == height - 1, F.lit(float(end if height > 1 else start))).otherwise(t)
    return cells.withColumn("t", last.cast("float"))
