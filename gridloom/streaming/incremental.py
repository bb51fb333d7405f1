"""Streaming counterpart of the mean: running means of cells over a stream of observations (an addition of this engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.assign import assign
from gridloom.plans.gridspec import GridSpec


def streaming_mean(observed: DataFrame, spec: GridSpec, input_fill: float = -999.0) -> DataFrame:
    """v, u, value, n: to be written in update or complete mode.  The state is one sum and count for each cell of the grid."""
    rows = observed.withColumn("value", F.col("value").cast("double")).where(F.col("value") != F.lit(float(input_fill)))
    return assign(rows, spec).groupBy("v", "u").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
