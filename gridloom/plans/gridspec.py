"""The output grid: its geometry in 32-bit arithmetic, on the driver and as Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Earth's girth over the equator and over the poles, in metres.
EQUATOR, MERIDIAN = 40075017.0, 40007863.0

f32 = np.float32


@dataclass(frozen=True)
class Bounds:
    """A closed box in projected space and time."""

    x_lo: float = -math.inf
    x_hi: float = math.inf
    y_lo: float = -math.inf
    y_hi: float = math.inf
    t_lo: float = -math.inf
    t_hi: float = math.inf

    def predicate(self, x: str = "x", y: str = "y", t: str = "t") -> Column:
        """Only the bounds that are finite, so that they reach the scan."""
        found = F.lit(True)
        for col, low, high in ((x, self.x_lo, self.x_hi), (y, self.y_lo, self.y_hi), (t, self.t_lo, self.t_hi)):
            for bound, op in ((low, "ge"), (high, "le")):
                if math.isnan(bound):
                    raise ValueError("a bound isn't a number")
                if math.isfinite(bound):
                    v = F.lit(float(f32(bound))).cast("float")
                    found = found & (F.col(col) >= v if op == "ge" else F.col(col) <= v)
                elif (bound > 0) == (op == "ge"):
                    return F.lit(False)
        return found


@dataclass(frozen=True)
class GridSpec:
    """Width and height in cells, resolutions and sampling boxes in metres, centre, and the time range.

    Sampling boxes default to the cells; larger ones overlap, smaller ones leave gaps.
    """

    width: int = 720
    height: int = 360
    hres: float | None = None
    vres: float | None = None
    central_x: float = 0.0
    central_y: float = 0.0
    hsample: float | None = None
    vsample: float | None = None
    time_min: float = -math.inf
    time_max: float = math.inf

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0:
            raise ValueError("width and height must be above 0")
        put = lambda k, v: object.__setattr__(self, k, v)
        put("hres", float(f32(EQUATOR / self.width if self.hres is None else self.hres)))
        put("vres", float(f32(MERIDIAN / (2 * self.height) if self.vres is None else self.vres)))
        for name in ("hres", "vres", "hsample", "vsample"):
            v = getattr(self, name)
            if v is not None and not (v > 0 and math.isfinite(v)):
                raise ValueError(f"{name} must be above 0")
        for name in ("central_x", "central_y"):
            if not math.isfinite(getattr(self, name)):
                raise ValueError(f"{name} must be a finite number")
            put(name, float(f32(getattr(self, name))))
        if math.isnan(self.time_min) or math.isnan(self.time_max):
            raise ValueError("the time range isn't a number")

    @property
    def h_offset(self) -> float:
        return float(f32(self.hres) / f32(2) if self.hsample is None else f32(self.hsample) / f32(2))

    @property
    def v_offset(self) -> float:
        return float(f32(self.vres) / f32(2) if self.vsample is None else f32(self.vsample) / f32(2))

    @property
    def x_0(self) -> float:
        return float(f32(self.central_x - (self.width / 2.0) * self.hres))

    @property
    def y_0(self) -> float:
        return float(f32(self.central_y - (self.height / 2.0) * self.vres))

    def axis(self, name: str) -> tuple[float, float, float, int]:
        """Origin, resolution, offset and cells of ``x`` or ``y``."""
        return (self.x_0, self.hres, self.h_offset, self.width) if name == "x" else (self.y_0, self.vres, self.v_offset, self.height)

    def centre(self, k: Column, name: str) -> Column:
        """The 32-bit centre of cell number k along an axis."""
        origin, res, _, _ = self.axis(name)
        return (F.lit(origin) + (k + F.lit(0.5)) * F.lit(res)).cast("float")

    def box(self, k: Column, name: str) -> tuple[Column, Column]:
        """The closed 32-bit box of cell number k along an axis."""
        off = F.lit(self.axis(name)[2]).cast("float")
        c = self.centre(k, name)
        return c - off, c + off

    def skeleton(self, spark: SparkSession) -> DataFrame:
        """Every cell: v, u (from the lowest y and x), row (from the top), col, idx, x, y."""
        n = self.width * self.height
        cells = spark.range(n).select(F.col("id").alias("idx"))
        w = F.lit(self.width).cast("long")
        cells = cells.select("idx", F.floor(F.col("idx") / w).cast("int").alias("row"), F.pmod("idx", w).cast("int").alias("col"))
        cells = cells.withColumn("v", F.lit(self.height - 1) - F.col("row")).withColumn("u", F.col("col"))
        return cells.withColumn("x", self.centre(F.col("u"), "x")).withColumn("y", self.centre(F.col("v"), "y"))
