"""Cell assignment: which sampling boxes hold each observation, by arithmetic.

The candidates along an axis are a short range of cell numbers, widened by one on either side against rounding; the exact 32-bit box
decides.  A point can be in none, one or several cells.  The cost is one projection and two generators, with no join; the x axis is
settled before the y axis is unfolded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.gridspec import Bounds, GridSpec


def candidates(value: Column, spec: GridSpec, axis: str) -> Column:
    """The array of cell numbers that may hold the value; null where there are none."""
    origin, res, off, cells = spec.axis(axis)
    place = value.cast("double") - F.lit(origin)
    clip = lambda c: F.least(F.greatest(c, F.lit(-3.0)), F.lit(cells + 3.0))
    low = F.greatest((F.ceil(clip((place - F.lit(off)) / F.lit(res) - 0.5)) - 1).cast("int"), F.lit(0))
    high = F.least((F.floor(clip((place + F.lit(off)) / F.lit(res) - 0.5)) + 1).cast("int"), F.lit(cells - 1))
    return F.when(low <= high, F.sequence(low, high))


def assign(obs: DataFrame, spec: GridSpec) -> DataFrame:
    """One row per observation and cell whose closed box holds it: the columns of ``obs`` (x and y among them), u and v."""
    if set(obs.columns) & {"u", "v"}:
        raise ValueError("observations may not have columns u or v")
    timed = obs.where(Bounds(t_lo=spec.time_min, t_hi=spec.time_max).predicate()) if "t" in obs.columns else obs
    found = timed
    for axis, k in (("x", "u"), ("y", "v")):
        found = found.select("*", F.explode(candidates(F.col(axis), spec, axis)).alias(k))
        low, high = spec.box(F.col(k), axis)
        found = found.where((F.col(axis) >= low) & (F.col(axis) <= high))
    return found


def distances(spec: GridSpec, compat: bool = False) -> tuple[Column, Column]:
    """(squared distance, distance) of an assigned observation to its cell's centre.

    ``compat`` takes 32-bit steps and the historical centre, whose y mixes the box's right and lower edges.
    """
    (x_lo, x_hi), (y_lo, y_hi) = spec.box(F.col("u"), "x"), spec.box(F.col("v"), "y")
    return box_distances(x_lo, x_hi, y_lo, y_hi, compat)


def box_distances(x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column, compat: bool = False) -> tuple[Column, Column]:
    cx = ((x_lo + x_hi) / F.lit(2.0)).cast("double")
    cy = (((x_hi if compat else y_hi) + y_lo) / F.lit(2.0)).cast("double")
    dx, dy = cx - F.col("x"), cy - F.col("y")
    if compat:
        square = lambda d: (d.cast("float").cast("double") * d.cast("float").cast("double")).cast("float")
        d2 = (square(dx) + square(dy)).cast("float").cast("double")
    else:
        d2 = dx * dx + dy * dy
    return d2, F.sqrt(d2)
