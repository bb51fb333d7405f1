"""The fourteen storage types: their Spark types, styles, ranges, and casts in and out.

Numeric values are worked on as doubles; coded values are opaque bytes that are only carried.  Spark has no unsigned types, so these are
stored in the next larger one.  Casting out truncates toward zero, as C does; what the type can't hold becomes the fill value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DType:
    """A storage type: its name, bytes of an item, style (``numeric`` or ``coded``) and Spark type."""

    name: str
    size: int
    style: str
    spark: str

    @property
    def numpy(self) -> np.dtype:
        return np.dtype(self.name) if self.style == "numeric" else np.dtype(f"V{self.size}")

    @property
    def whole(self) -> bool:
        return self.style == "numeric" and not self.name.startswith("float")

    def bounds(self) -> tuple[int, int]:
        info = np.iinfo(self.name)
        return int(info.min), int(info.max)


_ALL = [
    *(DType(f"uint{8 * n}", n, "numeric", s) for n, s in ((1, "smallint"), (2, "int"), (4, "bigint"), (8, "decimal(20,0)"))),
    *(DType(f"int{8 * n}", n, "numeric", s) for n, s in ((1, "tinyint"), (2, "smallint"), (4, "int"), (8, "bigint"))),
    DType("float32", 4, "numeric", "float"),
    DType("float64", 8, "numeric", "double"),
    *(DType(f"coded{8 * n}", n, "coded", "binary") for n in (1, 2, 4, 8)),
]
DTYPES = {d.name: d for d in _ALL}


def dtype(name: str) -> DType:
    if name not in DTYPES:
        raise ValueError(f"unknown dtype {name!r}; one of {', '.join(DTYPES)}")
    return DTYPES[name]


def representable(value: float, d: DType) -> bool:
    """Whether a fill value can be stored exactly enough to be written at all."""
    if not d.whole:
        return True
    low, high = d.bounds()
    return np.isfinite(value) and low <= int(value) <= high


def numeric(value: Column) -> Column:
    """A stored value as a working value."""
    return value.cast("double")


def stored(value: Column, d: DType, fill: float) -> Column:
    """A working value as a stored one: truncated, and the fill value where it is null or out of range."""
    if d.style == "coded":
        raise ValueError("coded values can't be computed")
    if not representable(fill, d):
        raise ValueError(f"the output fill value {fill} can't be stored as {d.name}")
    value = F.coalesce(value, F.lit(float(fill)))
    if not d.whole:
        return value.cast(d.spark)
    low, high = d.bounds()
    # decimals hold every 64-bit integer, so the comparison is exact
    exact = _truncated(value)
    whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    return F.when(exact.between(whole(low), whole(high)), exact).otherwise(whole(int(fill))).cast(d.spark)


def _truncated(value: Column) -> Column:
    """The whole part, exactly: doubles go to decimals in two halves of 32 bits; null beyond 20 digits and for NaN."""
    size = F.when(F.abs(value) < 1e19 * 2, F.abs(value))
    high = F.floor(size / F.lit(4294967296.0))
    low = F.floor(size - high.cast("double") * F.lit(4294967296.0))
    whole = (high.cast("decimal(12,0)") * F.lit("4294967296").cast("decimal(11,0)") + low.cast("decimal(12,0)")).cast("decimal(21,0)")
    return F.when(value < 0, -whole).otherwise(whole).try_cast("decimal(20,0)")
