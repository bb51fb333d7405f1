"""Saved geometry: projected observations as Parquet, laid out by tile, with their projection beside them.

It holds geometry alone, so one index serves many products: join values by ``record_index``.  Rows are sorted by tile, so
the row groups' smallest and largest x and y let a box query skip most of the file.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.projection import Projection

VERSION = 1


@dataclass(frozen=True)
class Index:
    observed: DataFrame
    projection: Projection
    num_observations: int
    tile: float | None = None


def save_index(observed: DataFrame, path: str, projection: Projection | str, tile: float = 250_000.0) -> None:
    """Write record_index, x, y, t; ``tile`` is the side in metres of the squares that are kept together."""
    p = Projection.parse(projection) if isinstance(projection, str) else projection
    spark = observed.sparkSession
    at = [F.floor(F.col(c) / F.lit(tile)) for c in ("y", "x")]
    rows = observed.select("record_index", "x", "y", "t").repartitionByRange(*at).sortWithinPartitions(*at, "x")
    rows.write.mode("overwrite").parquet(f"{path}/observations")
    n = spark.read.parquet(f"{path}/observations").count()
    meta = {"format_version": VERSION, "projection": p.definition, "num_observations": n, "tile": tile}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_index(spark: SparkSession, path: str) -> Index:
    """Read a saved index; its version, projection and count are checked."""
    lines = [r.value for r in spark.read.text(f"{path}/metadata").limit(2).collect()]
    try:
        (line,) = lines
        meta = json.loads(line)
        version, definition, n, tile = meta["format_version"], meta["projection"], int(meta["num_observations"]), meta.get("tile")
    except (ValueError, KeyError, TypeError):
        raise ValueError(f"{path}: the index's metadata is corrupt") from None
    if version != VERSION:
        raise ValueError(f"{path}: index version {version}, expected {VERSION}")
    observed = spark.read.schema("record_index bigint, x float, y float, t float").parquet(f"{path}/observations")
    if observed.count() != n:
        raise ValueError(f"{path}: the index doesn't hold {n} observations")
    return Index(observed, Projection.parse(definition), n, tile)


def check_index(spark: SparkSession, path: str) -> DataFrame:
    """One row: the number of observations, and whether their numbers are unique, their places finite and their tiles whole.

    A tile is whole if one file holds all of it; the ranges of x and y that files state can then rule out whole files.  Counts are
    combined in the tasks; no row is collected.
    """
    index = load_index(spark, path)
    rows = index.observed.withColumn("file", F.col("_metadata.file_path"))
    rows = rows.select("record_index", "x", "y", "t", "file", *(F.floor(F.col(c) / F.lit(index.tile or 250_000.0)).alias(f"tile_{c}") for c in ("y", "x")))
    numbers = rows.groupBy("record_index").count().agg(F.max("count").alias("most"))
    tiles = rows.groupBy("tile_y", "tile_x").agg(F.min("file").alias("a"), F.max("file").alias("b")).agg(F.bool_and(F.col("a") == F.col("b")).alias("whole"))
    ok = F.lit(True)
    for c in ("x", "y", "t"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    sums = rows.agg(F.count("*").alias("num_observations"), F.bool_and(ok).alias("finite"))
    one = lambda df, c: df.select(F.lit(1).alias("k"), c)
    sums = sums.withColumn("k", F.lit(1)).join(one(numbers, F.coalesce(F.col("most") == 1, F.lit(True)).alias("numbers_unique")), "k").join(one(tiles, F.coalesce("whole", F.lit(True)).alias("tiles_whole")), "k")
    return sums.select("num_observations", "numbers_unique", F.coalesce("finite", F.lit(True)).alias("finite"), "tiles_whole")


def with_values(index: Index, values: DataFrame) -> DataFrame:
    """Observations with the values (record_index, value) of one product."""
    return index.observed.join(values.select("record_index", "value"), "record_index")
