"""Map projections as Column expressions.

``Projection.parse`` reads a ``+proj=...`` definition.  Supported are ``eqc`` (equidistant cylindrical), ``merc`` (Mercator) and the kinds
of ``kinds.py`` (longlat, sinu, stere, laea, cea, lcc, tmerc, utm, and what ``register_projection`` adds), each on the sphere or the
ellipsoid, with ``+lon_0 +x_0 +y_0 +R +a +b +ellps +datum`` and the options of the kind; anything else is a ValueError.  Forward results
are 32-bit metres (radians for longlat), inverse results 32-bit degrees.  A place outside the domain projects to infinity, which no box
contains; a place on the plane that is no place on the earth goes back to null or NaN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.kinds import COLUMNS, KINDS, NUMBERS, register_projection

__all__ = ["DEFAULT", "Extent", "Projection", "extent", "register_projection"]

DEFAULT = "+proj=eqc +datum=WGS84"
#: Semi-major axis and flattening.
ELLIPSOIDS = {"WGS84": (6378137.0, 1 / 298.257223563), "GRS80": (6378137.0, 1 / 298.257222101), "sphere": (6370997.0, 0.0)}
_DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80"}
_FLAGS = {"no_defs", "wktext", "south"}
_NUMBERS = {"lon_0", "x_0", "y_0", "R", "a", "b"}
_PLAIN = {"lat_ts", "lat_0", "k_0", "k"}
_WORDS = {"proj", "ellps", "datum", "units", "type", "title", "no_defs", "wktext"}
#: Just over pi: longitudes within it aren't wrapped.
_HALF_TURN = 3.14159265359


@dataclass(frozen=True)
class Projection:
    """A projection; ``definition`` is the text it can be built from again."""

    definition: str
    kind: str
    a: float
    e: float
    lon_0: float = 0.0
    lat_0: float = 0.0
    k0: float = 1.0
    x_0: float = 0.0
    y_0: float = 0.0
    options: dict = field(default_factory=dict, compare=False)
    constants: SimpleNamespace | None = field(default=None, compare=False)

    @classmethod
    def parse(cls, definition: str) -> Projection:
        options = {}
        for word in definition.split():
            if not word.startswith("+"):
                raise ValueError(f"{word!r} in a projection: options begin with +")
            name, _, value = word[1:].partition("=")
            if not value and name not in _FLAGS:
                raise ValueError(f"unknown projection option {word!r}")
            options[name] = value
        kind = options.get("proj")
        if kind not in ("eqc", "merc") and kind not in KINDS:
            raise ValueError(f"unknown projection {kind!r}; one of {', '.join(sorted(['eqc', 'merc', *KINDS]))}")
        own = KINDS[kind].options if kind in KINDS else _PLAIN
        if unknown := set(options) - _WORDS - _NUMBERS - _PLAIN - own:
            raise ValueError(f"unknown projection options: {', '.join(sorted(unknown))}")
        if options.get("units", "m") != "m":
            raise ValueError("only metres are supported")
        try:
            number = {k: float(v or 1) for k, v in options.items() if k in _NUMBERS | _PLAIN | own}
        except ValueError as bad:
            raise ValueError(f"{definition!r}: {bad}") from None
        name = options.get("ellps") or _DATUMS.get(options.get("datum", "WGS84"))
        if name not in ELLIPSOIDS:
            raise ValueError(f"unknown ellipsoid or datum in {definition!r}")
        a, f = ELLIPSOIDS[name]
        if "a" in number:
            a = number["a"]
            f = 1 - number["b"] / a if "b" in number else f
        if "R" in number:
            a, f = number["R"], 0.0
        e2 = f * (2 - f)
        if kind in KINDS:
            if not (a > 0 and 0 <= e2 < 1):
                raise ValueError(f"{definition!r} has no valid size")
            constants = {k: number[k] for k in ("lon_0", "x_0", "y_0") if k in number} | KINDS[kind].setup(number, a, math.sqrt(e2))
            place = {k: constants.pop(k, 0.0) for k in ("lon_0", "x_0", "y_0")}
            return cls(definition, kind, a, math.sqrt(e2), options=options, constants=SimpleNamespace(**constants), **place)
        ts = math.radians(number.get("lat_ts", 0.0))
        if abs(ts) >= math.pi / 2 or not (a > 0 and 0 <= e2 < 1):
            raise ValueError(f"{definition!r} has no valid size or standard parallel")
        k0 = number.get("k_0", number.get("k", 1.0))
        if kind == "eqc":
            k0 = math.cos(ts)
        elif "lat_ts" in number:
            k0 = math.cos(ts) / math.sqrt(1 - e2 * math.sin(ts) ** 2)
        return cls(definition, kind, a, math.sqrt(e2), number.get("lon_0", 0.0), number.get("lat_0", 0.0), k0, number.get("x_0", 0.0), number.get("y_0", 0.0), options)

    # On the driver, in double precision: for extents.
    def forward_point(self, lon: float, lat: float) -> tuple[float, float]:
        lam, phi = math.radians(lon) - math.radians(self.lon_0), math.radians(lat)
        if abs(lam) > _HALF_TURN:
            lam = lam + math.pi - 2 * math.pi * math.floor((lam + math.pi) / (2 * math.pi)) - math.pi
        if abs(lat) > 90:
            return math.inf, math.inf
        if self.kind in KINDS:
            with np.errstate(all="ignore"):
                x, y, inside = KINDS[self.kind].forward(NUMBERS, self.constants, np.float64(lam), np.float64(phi))
            return (float(x) + self.x_0, float(y) + self.y_0) if inside and np.isfinite(x) and np.isfinite(y) else (math.inf, math.inf)
        x = self.a * self.k0 * lam
        if self.kind == "eqc":
            y = self.a * (phi - math.radians(self.lat_0))
        elif abs(abs(phi) - math.pi / 2) <= 1e-10:
            return math.inf, math.inf
        else:
            s = self.e * math.sin(phi)
            y = self.a * self.k0 * -math.log(math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (self.e / 2))
        return x + self.x_0, y + self.y_0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) in 32-bit metres of degrees."""
        lon, lat = lon.cast("double"), lat.cast("double")
        lam = F.radians(lon)
        if self.lon_0:
            lam = lam - F.lit(math.radians(self.lon_0))
        turn = F.lit(2 * math.pi)
        shifted = lam + F.lit(math.pi)
        lam = F.when(F.abs(lam) <= _HALF_TURN, lam).otherwise(shifted - turn * F.floor(F.when(F.abs(lon) < 1e9, shifted / turn)) - F.lit(math.pi))
        phi = F.radians(lat)
        inside = F.abs(lat) <= 90
        if self.kind in KINDS:
            x, y, domain = KINDS[self.kind].forward(COLUMNS, self.constants, lam, phi)
            for v in (x, y):
                domain = domain & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)
            return tuple(F.when(inside & domain, v + F.lit(o)).otherwise(F.lit(math.inf)).cast("float") for v, o in ((x, self.x_0), (y, self.y_0)))
        x = lam * F.lit(self.a if self.k0 == 1 else self.a * self.k0)
        if self.kind == "eqc":
            y = (phi - F.lit(math.radians(self.lat_0)) if self.lat_0 else phi) * F.lit(self.a)
        else:
            inside = inside & (F.abs(F.abs(phi) - F.lit(math.pi / 2)) > 1e-10)
            s = F.lit(self.e) * F.sin(phi)
            y = F.lit(-self.a * self.k0) * F.ln(F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2)))
        far = F.lit(math.inf)
        x, y = (c + F.lit(o) if o else c for c, o in ((x, self.x_0), (y, self.y_0)))
        return F.when(inside, x).otherwise(far).cast("float"), F.when(inside, y).otherwise(far).cast("float")

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lon, lat) in 32-bit degrees of metres."""
        x, y = x.cast("double") - F.lit(self.x_0), y.cast("double") - F.lit(self.y_0)
        if self.kind in KINDS:
            lam, phi = KINDS[self.kind].inverse(COLUMNS, self.constants, x, y)
            lon = F.degrees(lam) + F.lit(self.lon_0)
            lon = F.when(F.abs(lon) <= 180, lon).otherwise(lon - 360 * F.floor(F.when(F.abs(lon) < 1e9, (lon + 180) / 360)))
            return lon.cast("float"), F.degrees(phi).cast("float")
        lon = F.degrees(x / F.lit(self.a * self.k0)) + F.lit(self.lon_0)
        if self.kind == "eqc":
            return lon.cast("float"), (F.degrees(y / F.lit(self.a)) + F.lit(self.lat_0)).cast("float")
        t = F.exp(-y / F.lit(self.a * self.k0))
        half = F.lit(math.pi / 2)
        phi = half - 2 * F.atan(t)
        for _ in range(8 if self.e else 0):  # each round gains more than two digits; atanh keeps phi once in the expression
            phi = half - 2 * F.atan(t * F.exp(F.lit(-self.e) * F.atanh(F.lit(self.e) * F.sin(phi))))
        return lon.cast("float"), F.degrees(phi).cast("float")


@dataclass(frozen=True)
class Extent:
    central_x: float
    central_y: float
    width: int
    height: int


def extent(projection: Projection | str, north: float, south: float, east: float, west: float, hres: float, vres: float) -> Extent:
    """The grid that covers the area between two corners; not valid where the corners don't bound it (polar projections)."""
    p = Projection.parse(projection) if isinstance(projection, str) else projection
    if not (hres > 0 and vres > 0):
        raise ValueError("resolutions must be above 0")
    (x1, y1), (x0, y0) = p.forward_point(east, north), p.forward_point(west, south)
    if not all(map(math.isfinite, (x0, x1, y0, y1))):
        raise ValueError("a corner lies outside the projection's domain")
    size = lambda d, r: math.ceil(abs(d) / float(np.float32(r)))
    return Extent(float(np.float32((x1 + x0) / 2)), float(np.float32((y1 + y0) / 2)), size(x1 - x0, hres), size(y1 - y0, vres))
