"""The gridding plan: observations to a dense raster.

project -> assign to cells -> group by cell -> left join on the cells of the grid -> fill.  One shuffle on the cell number; the
reduction combines within each task before it where its aggregate allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DType, dtype, numeric, representable, stored
from gridloom.functions.projection import DEFAULT, Projection
from gridloom.functions.reductions import Observed, reduction
from gridloom.operators.assign import assign, distances
from gridloom.plans.gridspec import GridSpec

#: What a coded cell without an observation holds: this byte, as often as the type is wide.
CODED_FILL = b"\x00"


def validate(name: str, input_dtype: DType, output_dtype: DType, output_fill: float) -> None:
    """Refuse what can't be computed before anything runs."""
    r = reduction(name)
    if r.style == "coded" and (input_dtype.style != "coded" or output_dtype != input_dtype):
        raise ValueError(f"{name} needs equal coded input and output types")
    if r.style == "numeric" and not (input_dtype.style == output_dtype.style == "numeric"):
        raise ValueError(f"{name} needs numeric input and output types")
    if r.style == "numeric" and not representable(output_fill, output_dtype):
        raise ValueError(f"the output fill value {output_fill} can't be stored as {output_dtype.name}")


def reduce_cells(observed: DataFrame, spec: GridSpec, name: str, input_fill: float = -999.0, compat: bool = False) -> DataFrame:
    """v, u, value of the cells that have a value; observations hold record_index, x, y, t, value."""
    r = reduction(name)
    rows = observed.select("record_index", "x", "y", "t", "value")
    if r.style == "numeric":
        rows = rows.withColumn("value", numeric(F.col("value"))).where(F.col("value") != F.lit(float(input_fill)))
    d2, d = distances(spec, compat)
    cells = assign(rows, spec).select("v", "u", "t", "record_index", "value", d2.alias("d2"), d.alias("d"))
    value = F.col("value").cast("float").cast("double") if compat and name == "numeric_nearest_neighbour" else F.col("value")
    return cells.groupBy("v", "u").agg(r.build(Observed(value, F.col("t"), F.col("record_index"), F.col("d2"), F.col("d"))).alias("value"))


def grid_observed(observed: DataFrame, spec: GridSpec, name: str = "mean", input_dtype: str = "float64", output_dtype: str | None = None, input_fill: float = -999.0, output_fill: float = -999.0, projection: Projection | str = DEFAULT, geolocation: bool = False, compat: bool = False) -> DataFrame:
    """The raster of projected observations: row (from the top), col, idx, x, y, value and, if asked for, lon, lat."""
    kind, out = dtype(input_dtype), dtype(output_dtype or input_dtype)
    validate(name, kind, out, output_fill)
    values = reduce_cells(observed, spec, name, input_fill, compat)
    cells = spec.skeleton(observed.sparkSession).join(values, ["v", "u"], "left")
    if out.style == "coded":
        value = F.coalesce("value", F.lit(CODED_FILL * out.size))
    else:
        value = stored(F.col("value"), out, output_fill)
    columns = ["row", "col", "idx", "x", "y", value.alias("value")]
    if geolocation:
        columns += _geolocated(projection)
    return cells.select(*columns)


def _geolocated(projection: Projection | str) -> list:
    p = Projection.parse(projection) if isinstance(projection, str) else projection
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    return [lon.alias("lon"), lat.alias("lat")]


def grid_geolocation(spark, spec: GridSpec, projection: Projection | str = DEFAULT) -> DataFrame:
    """row, col, idx, x, y, lon, lat of every cell's centre."""
    return spec.skeleton(spark).select("row", "col", "idx", "x", "y", *_geolocated(projection))


def grid_observations(obs: DataFrame, spec: GridSpec, name: str = "mean", projection: Projection | str = DEFAULT, mode: str = "failfast", **options) -> DataFrame:
    """The raster of observations (record_index, lon, lat, [t,] value): ``observe``, then ``grid_observed``."""
    from gridloom.operators.query import observe

    return grid_observed(observe(obs, projection, mode), spec, name, projection=projection, **options)


def masked(raster: DataFrame, fill: float = -999.0, log: bool = False) -> DataFrame:
    """The raster with null for fill values, and the logarithm of the rest if asked for (null where there is none)."""
    value = F.when(numeric(F.col("value")) != F.lit(float(fill)), numeric(F.col("value")))
    return raster.withColumn("value", F.log10(value) if log else value)


def to_masked_numpy(raster: DataFrame, width: int, height: int, fill: float = -999.0, log: bool = False) -> np.ma.MaskedArray:
    """A raster as a masked array of rows from the top, for a viewer: it comes to the driver, 8 bytes a cell."""
    cells = masked(raster, fill, log).where("value IS NOT NULL").select("idx", "value").toPandas()
    out = np.ma.masked_all(width * height, np.float64)
    out[cells["idx"].to_numpy()] = cells["value"].to_numpy()
    return out.reshape(height, width)


def all_fill(raster: DataFrame, fill: float = -999.0) -> DataFrame:
    """One row: whether the raster holds nothing but the fill value."""
    return raster.agg(F.coalesce(F.bool_and(numeric(F.col("value")) == F.lit(float(fill))), F.lit(True)).alias("all_fill"))
