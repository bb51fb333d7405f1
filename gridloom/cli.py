"""Command line: flat files in, rasters out.  ``python -m gridloom.cli --help``; ``extent`` as first word computes a grid's extent."""

from __future__ import annotations

import argparse
import math
import sys

from gridloom.functions.dtypes import DTYPES, dtype
from gridloom.functions.projection import DEFAULT, Projection, extent
from gridloom.functions.reductions import reductions
from gridloom.plans.gridspec import GridSpec
from gridloom.plans.pipeline import grid_geolocation, grid_observed, validate


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom", description="Grid irregular observations.")
    add = p.add_argument
    add("--input-lats")
    add("--input-lons")
    add("--input-time")
    add("--projection", default=DEFAULT)
    add("--save-index")
    add("--load-index")
    add("--input-data")
    add("--input-dtype", default="float32", choices=list(DTYPES))
    add("--output-dtype", choices=list(DTYPES))
    add("--input-fill-value", type=float, default=-999.0)
    add("--output-fill-value", type=float, default=-999.0)
    add("--output-data")
    add("--output-lats")
    add("--output-lons")
    add("--height", type=int, default=360)
    add("--width", type=int, default=720)
    for name in ("--vres", "--hres", "--vsample", "--hsample"):
        add(name, type=float)
    add("--central-x", type=float, default=0.0)
    add("--central-y", type=float, default=0.0)
    add("--reduction-function", default="mean", choices=reductions())
    add("--time-min", type=float, default=-math.inf)
    add("--time-max", type=float, default=math.inf)
    add("--verbose", action="store_true")
    return p


def _extent(words: list[str]) -> int:
    p = argparse.ArgumentParser(prog="gridloom extent")
    p.add_argument("projection")
    for name in ("n_lat", "s_lat", "e_lon", "w_lon", "hres", "vres"):
        p.add_argument(name, type=float)
    a = p.parse_args(words)
    e = extent(a.projection, a.n_lat, a.s_lat, a.e_lon, a.w_lon, a.hres, a.vres)
    print(f"Centre: ({e.central_x:f}, {e.central_y:f})\nWidth: {e.width}\nHeight: {e.height}")
    return 0


def checked(words: list[str]) -> argparse.Namespace:
    """Parsed and consistent arguments."""
    p = parser()
    a = p.parse_args(words)
    a.image = bool(a.output_data or a.output_lats or a.output_lons)
    if not a.image and not a.save_index:
        p.error("nothing to do: give an output or --save-index")
    if a.load_index and a.save_index:
        p.error("--load-index and --save-index exclude each other")
    if not a.load_index and not (a.input_lats and a.input_lons):
        p.error("--input-lats and --input-lons are required without --load-index")
    if a.image and not (a.input_data and a.output_data):
        p.error("an image needs --input-data and --output-data")
    try:
        a.spec = GridSpec(a.width, a.height, a.hres, a.vres, a.central_x, a.central_y, a.hsample, a.vsample, a.time_min, a.time_max)
        a.output_dtype = a.output_dtype or a.input_dtype
        if a.image:
            validate(a.reduction_function, dtype(a.input_dtype), dtype(a.output_dtype), a.output_fill_value)
        Projection.parse(a.projection)
    except ValueError as bad:
        p.error(str(bad))
    return a


def main(words: list[str] | None = None) -> int:
    words = sys.argv[1:] if words is None else words
    if words[:1] == ["extent"]:
        return _extent(words[1:])
    a = checked(words)
    from pyspark.sql import SparkSession

    from gridloom.operators.query import observe
    from gridloom.sources.index import load_index, save_index
    from gridloom.sources.rawio import read_raw, write_raster

    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if a.load_index:
        index = load_index(spark, a.load_index)
        observed, projection = index.observed, index.projection
    else:
        projection = Projection.parse(a.projection)
        observed = observe(read_raw(spark, a.input_lats, a.input_lons, a.input_time), projection)
        if a.save_index:
            save_index(observed, a.save_index, projection)
            observed = load_index(spark, a.save_index).observed
    if a.image:
        values = read_raw(spark, data=a.input_data, dtype=a.input_dtype)
        raster = grid_observed(observed.join(values, "record_index"), a.spec, a.reduction_function, a.input_dtype, a.output_dtype, a.input_fill_value, a.output_fill_value, projection)
        items = a.width * a.height
        write_raster(raster, a.output_data, items, a.output_dtype)
        for path, column in ((a.output_lats, "lat"), (a.output_lons, "lon")):
            if path:
                write_raster(grid_geolocation(spark, a.spec, projection), path, items, "float32", column)
    if a.verbose:
        print(f"{a.width} x {a.height} cells, {a.reduction_function}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
