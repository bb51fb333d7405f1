"""Every query of the grid engine over the driver's tables, with its DuckDB counterpart.

The tables have no coordinates, so observations are derived from ``events`` (and, for volume, ``lineitem``) by the same
arithmetic in both engines.  The counterparts are literal: a BETWEEN join of all cells with all observations (for the default grid, of
all cells next to each observation), and projections by other forms of the same formulas.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DTYPES
from gridloom.functions.projection import Projection, extent
from gridloom.operators import query as q
from gridloom.operators.assign import assign
from gridloom.plans import pipeline as p
from gridloom.plans.gridspec import Bounds, GridSpec
from gridloom.sources.index import check_index, load_index, save_index
from gridloom.sources.rawio import read_raster, read_raw, write_raster
from gridloom.sources.scratch import local_path, scratch
from gridloom.sources.timemap import linear_timemap

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MERC = "+proj=merc +ellps=WGS84 +lat_ts=55.0 +lon_0=-15.0"
TENS = GridSpec(36, 18)
OVER = GridSpec(36, 18, hsample=3 * TENS.hres, vsample=3 * TENS.vres)
UNDER = GridSpec(36, 18, hsample=0.4 * TENS.hres, vsample=0.4 * TENS.vres)
TIMED = GridSpec(36, 18, time_min=1000, time_max=6000)
FINE = GridSpec()
BOX = Bounds(-5e6, 5e6, -2e6, 6e6)
BOX_TIME = Bounds(-5e6, 5e6, -2e6, 6e6, 1000, 6000)


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# Observations.
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_index, lon, lat, t, value; every fourth value is the fill value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    return e.select(
        F.col("event_id").alias("record_index"),
        ((F.col("event_id") * 7919 % 36000).cast("double") / F.lit(100.0) - 180).cast("float").alias("lon"),
        ((F.col("event_id") * 104729 % 18000).cast("double") / F.lit(100.0) - 90).cast("float").alias("lat"),
        F.col("event_id").cast("float").alias("t"),
        F.when(F.col("event_id") % 4 == 0, F.lit(-999.0)).otherwise(F.col("value")).alias("value"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from ``lineitem``: six times as many observations."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    return rows.select(key.alias("record_index"), ((key * 7919 % 36000).cast("double") / F.lit(100.0) - 180).cast("float").alias("lon"), ((key * 104729 % 18000).cast("double") / F.lit(100.0) - 90).cast("float").alias("lat"), F.col("l_quantity").cast("double").alias("value"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.observe(events(spark, sf_dir))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of four opaque bytes."""
    o = observed(spark, sf_dir)
    return o.withColumn("value", F.unhex(F.substring(F.md5(F.col("record_index").cast("string").cast("binary")), 1, 8)))


_EVENTS = """
obs AS (SELECT event_id AS record_index, CAST(CAST((event_id * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 AS FLOAT) AS lon,
        CAST(CAST((event_id * 104729) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - 90 AS FLOAT) AS lat, CAST(event_id AS FLOAT) AS t,
        CASE WHEN event_id % 4 = 0 THEN CAST(-999 AS DOUBLE) ELSE value END AS value,
        unhex(substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS code FROM events)"""
_LINES = """
obs AS (SELECT k AS record_index, CAST(CAST((k * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 AS FLOAT) AS lon,
        CAST(CAST((k * 104729) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - 90 AS FLOAT) AS lat, CAST(0 AS FLOAT) AS t, value
        FROM (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS k, CAST(l_quantity AS DOUBLE) AS value FROM lineitem))"""
_XY = """
xy AS (SELECT *, CAST(radians(CAST(lon AS DOUBLE)) * CAST(6378137 AS DOUBLE) AS FLOAT) AS x, CAST(radians(CAST(lat AS DOUBLE)) * CAST(6378137 AS DOUBLE) AS FLOAT) AS y FROM obs)"""


def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _f(v: float) -> str:
    return f"CAST({_d(v)} AS FLOAT)"


def _cells(g: GridSpec) -> str:
    """All cells with their centres and boxes."""
    return f"""
cells AS (SELECT *, x - {_f(g.h_offset)} AS x_lo, x + {_f(g.h_offset)} AS x_hi, y - {_f(g.v_offset)} AS y_lo, y + {_f(g.v_offset)} AS y_hi FROM (
          SELECT CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, CAST({g.height - 1} - v AS INTEGER) AS row, CAST(u AS INTEGER) AS col,
                 CAST(({g.height - 1} - v) * {g.width} + u AS BIGINT) AS idx,
                 CAST({_d(g.x_0)} + (u + {_d(0.5)}) * {_d(g.hres)} AS FLOAT) AS x, CAST({_d(g.y_0)} + (v + {_d(0.5)}) * {_d(g.vres)} AS FLOAT) AS y
          FROM (SELECT unnest(generate_series(0, {g.height - 1})) AS v), (SELECT unnest(generate_series(0, {g.width - 1})) AS u)))"""


def _met(g: GridSpec, compat: bool = False, near: bool = False) -> str:
    """Cells with the observations in their boxes; d2 and d to the centre.

    ``near``: an observation meets the nine cells around its place alone.  Where boxes are no larger than cells, those are all it can be in.
    """
    cx = f"CAST((c.x_lo + c.x_hi) / {_d(2.0)} AS DOUBLE)"
    cy = f"CAST(({'c.x_hi' if compat else 'c.y_hi'} + c.y_lo) / {_d(2.0)} AS DOUBLE)"
    dx, dy = f"({cx} - o.x)", f"({cy} - o.y)"
    if compat:
        square = lambda d: f"CAST(CAST(CAST({d} AS FLOAT) AS DOUBLE) * CAST(CAST({d} AS FLOAT) AS DOUBLE) AS FLOAT)"
        d2 = f"CAST(CAST({square(dx)} + {square(dy)} AS FLOAT) AS DOUBLE)"
    else:
        d2 = f"({dx} * {dx} + {dy} * {dy})"
    timed = "" if g.time_min == float("-inf") else f" AND o.t BETWEEN {_f(g.time_min)} AND {_f(g.time_max)}"
    if near:
        at = lambda c, origin, res: f"CAST(floor((CAST({c} AS DOUBLE) - {_d(origin)}) / {_d(res)}) AS INTEGER)"
        return f"""
placed AS (SELECT *, {at("x", g.x_0, g.hres)} + du AS u, {at("y", g.y_0, g.vres)} + dv AS v FROM xy, (SELECT unnest([-1, 0, 1]) AS du), (SELECT unnest([-1, 0, 1]) AS dv)),
met AS (SELECT o.*, {d2} AS d2, sqrt({d2}) AS d FROM cells c JOIN placed o USING (v, u) WHERE o.x BETWEEN c.x_lo AND c.x_hi AND o.y BETWEEN c.y_lo AND c.y_hi{timed})"""
    return f"""
met AS (SELECT c.v, c.u, o.*, {d2} AS d2, sqrt({d2}) AS d FROM cells c JOIN xy o ON o.x BETWEEN c.x_lo AND c.x_hi AND o.y BETWEEN c.y_lo AND c.y_hi{timed})"""


_AGG = {
    "mean": "avg(value)",
    "weighted_mean": "sum(value * d) / nullif(sum(d), 0)",
    "median": "median(value)",
    "numeric_nearest_neighbour": "arg_min(value, (d2, record_index))",
    "newest": "arg_max(value, (t, -record_index))",
}


def grid_sql(g: GridSpec, name: str, value: str | None = None, compat: bool = False, fill: str = "value <> -999", obs: str = _EVENTS, near: bool = False) -> str:
    value = value or "round(coalesce(a, CAST(-999 AS DOUBLE)), 6)"
    return f"""WITH {obs},{_XY},{_cells(g)},{_met(g, compat, near)},
r AS (SELECT v, u, {_AGG[name]} AS a FROM met WHERE {fill} GROUP BY v, u)
SELECT row, col, idx, x, y, {value} AS value FROM cells LEFT JOIN r USING (v, u)"""


def _shown(c: str, digits: int) -> Column:
    """The rounded column.  Spark's round loses the sign of a zero, which SQL keeps."""
    wide = F.col(c).cast("double")
    near = F.round(wide, digits)
    return F.when(near == 0, wide * F.lit(0.0)).otherwise(near).alias(c)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


# Projections.
@register("project_eqc_forward", f"WITH {_EVENTS},{_XY} SELECT record_index, x, y FROM xy")
def _(spark, sf_dir):
    return observed(spark, sf_dir).select("record_index", "x", "y")


@register("project_eqc_inverse", f"WITH {_EVENTS},{_XY} SELECT record_index, CAST(degrees(CAST(x AS DOUBLE) / CAST(6378137 AS DOUBLE)) AS FLOAT) AS lon, CAST(degrees(CAST(y AS DOUBLE) / CAST(6378137 AS DOUBLE)) AS FLOAT) AS lat FROM xy")
def _(spark, sf_dir):
    lon, lat = Projection.parse("+proj=eqc +datum=WGS84").inverse(F.col("x"), F.col("y"))
    return observed(spark, sf_dir).select("record_index", lon.alias("lon"), lat.alias("lat"))


_M = Projection.parse(MERC)
_PI = "pi()"
_MERC_XY = f"""
lam AS (SELECT record_index, radians(CAST(lat AS DOUBLE)) AS phi, abs(CAST(lat AS DOUBLE)) AS far, radians(CAST(lon AS DOUBLE)) - {_d(-0.2617993877991494)} AS l FROM obs),
m AS (SELECT record_index, CASE WHEN far <= 90 AND abs(abs(phi) - pi() / 2) > 1e-10 THEN 1 END AS ok, phi,
      CASE WHEN abs(l) <= {_d(3.14159265359)} THEN l ELSE (l + pi()) - {_d(6.283185307179586)} * floor((l + pi()) / {_d(6.283185307179586)}) - pi() END AS l, {_d(_M.e)} * sin(phi) AS s FROM lam),
xy AS (SELECT record_index, CASE WHEN ok = 1 THEN CAST(l * {_d(_M.a * _M.k0)} AS FLOAT) ELSE CAST('inf' AS FLOAT) END AS x,
       CASE WHEN ok = 1 THEN CAST({_d(-_M.a * _M.k0)} * ln(tan({_d(0.7853981633974483)} - phi / 2) / pow((1 - s) / (1 + s), {_d(_M.e / 2)})) AS FLOAT) ELSE CAST('inf' AS FLOAT) END AS y FROM m)"""


@register("project_merc_forward", f"WITH {_EVENTS},{_MERC_XY} SELECT record_index, round(CAST(x AS DOUBLE), 0) AS x, round(CAST(y AS DOUBLE), 0) AS y FROM xy")
def _(spark, sf_dir):
    o = q.observe(events(spark, sf_dir), MERC)
    return o.select("record_index", _shown("x", 0), _shown("y", 0))


def _merc_inverse_sql() -> str:
    phi, out = f"pi() / 2 - 2 * atan(t)", []
    for k in range(8):
        out.append(f"p{k} AS (SELECT *, pi() / 2 - 2 * atan(t * exp({_d(-_M.e)} * atanh({_d(_M.e)} * sin({'phi0' if not k else f'phi{k}'})))) AS phi{k + 1} FROM {'t0' if not k else f'p{k - 1}'})")
    return f"""WITH {_cells(TENS)},
t0 AS (SELECT row, col, idx, x, y, exp(-CAST(y AS DOUBLE) / {_d(_M.a * _M.k0)}) AS t, pi() / 2 - 2 * atan(exp(-CAST(y AS DOUBLE) / {_d(_M.a * _M.k0)})) AS phi0 FROM cells),
{", ".join(out)}
SELECT row, col, idx, x, y, round(CAST(CAST(degrees(CAST(x AS DOUBLE) / {_d(_M.a * _M.k0)}) + {_d(-15.0)} AS FLOAT) AS DOUBLE), 4) AS lon, round(CAST(CAST(degrees(phi8) AS FLOAT) AS DOUBLE), 4) AS lat FROM p7"""


@register("grid_geolocation_merc", _merc_inverse_sql())
def _(spark, sf_dir):
    g = p.grid_geolocation(spark, TENS, MERC)
    return g.withColumns({c: _shown(c, 4) for c in ("lon", "lat")})


# Further kinds of projection.  A counterpart gives x and y of each observation, or lon and lat of each cell, in textbook form.
_A, _E2 = 6378137.0, (2 - 1 / 298.257223563) / 298.257223563
_E = math.sqrt(_E2)
_N = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
_INF = "CAST('inf' AS FLOAT)"
NEAR_EUROPE = GridSpec(36, 18, 100_000.0, 100_000.0, 4_321_000.0, 3_210_000.0)
NEAR_ZONE = GridSpec(36, 18, 30_000.0, 60_000.0, 500_000.0, 5_000_000.0)


def _angles(lon_0: float) -> str:
    """Radians: l from the central meridian, within half a turn, and phi."""
    turn = _d(2 * math.pi)
    return f"""
raw AS (SELECT *, radians(CAST(lat AS DOUBLE)) AS phi, radians(CAST(lon AS DOUBLE)) - {_d(math.radians(lon_0))} AS l0 FROM obs),
ang AS (SELECT record_index, lon, lat, phi, CASE WHEN abs(l0) <= {_d(3.14159265359)} THEN l0 ELSE l0 + pi() - {turn} * floor((l0 + pi()) / {turn}) - pi() END AS l FROM raw)"""


def _metres(x: str, y: str, inside: str = "true") -> str:
    out = ", ".join(f"CASE WHEN {inside} THEN round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 0) ELSE {_INF} END AS {n}" for n, v in (("x", x), ("y", y)))
    return f"SELECT record_index, {out}"


def _degrees(lon: str, lat: str, lon_0: float) -> str:
    turned = f"(degrees({lon}) + {_d(lon_0)})"
    turned = f"CASE WHEN abs({turned}) <= 180 THEN {turned} ELSE {turned} - 360 * floor(({turned} + 180) / 360) END"
    return f"SELECT row, col, idx, x, y, round(CAST(CAST({turned} AS FLOAT) AS DOUBLE), 3) AS lon, round(CAST(CAST(degrees({lat}) AS FLOAT) AS DOUBLE), 3) AS lat"


def _chain(first: str, steps: int, source: str, start: str) -> tuple[str, str]:
    """CTEs that improve phi step by step; ``first`` has phi as {p}."""
    ctes = [f"i0 AS (SELECT *, {start} AS p0 FROM {source})"]
    ctes += [f"i{k} AS (SELECT *, {first.format(p=f'p{k - 1}')} AS p{k} FROM i{k - 1})" for k in range(1, steps + 1)]
    return ", ".join(ctes), f"p{steps}"


def _forward(definition: str, where: str | None = None):
    def run(spark, sf_dir):
        seen = events(spark, sf_dir)
        o = q.observe(seen.where(where) if where else seen, definition)
        return o.select("record_index", _shown("x", 0), _shown("y", 0))

    return run


def _inverse(definition: str, g: GridSpec):
    return lambda spark, sf_dir: p.grid_geolocation(spark, g, definition).withColumns({c: _shown(c, 3) for c in ("lon", "lat")})


# longlat: radians
register("project_longlat_forward", f"WITH {_EVENTS},{_angles(0)} SELECT record_index, round(CAST(CAST(l AS FLOAT) AS DOUBLE), 5) AS x, round(CAST(CAST(phi AS FLOAT) AS DOUBLE), 5) AS y FROM ang")(
    lambda spark, sf_dir: q.observe(events(spark, sf_dir), "+proj=longlat +datum=WGS84").select("record_index", _shown("x", 5), _shown("y", 5))
)

# sinusoidal: the meridian's length by powers of the squared eccentricity
_SINU = "+proj=sinu +datum=WGS84"
_M0, _M2, _M4, _M6, _M8 = (
    1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256 - 175 * _E2**4 / 16384,
    3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024 + 105 * _E2**4 / 4096,
    15 * _E2**2 / 256 + 45 * _E2**3 / 1024 + 525 * _E2**4 / 16384,
    35 * _E2**3 / 3072 + 175 * _E2**4 / 12288,
    315 * _E2**4 / 131072,
)
_LENGTH = f"{_d(_A)} * ({_d(_M0)} * {{p}} - {_d(_M2)} * sin(2 * {{p}}) + {_d(_M4)} * sin(4 * {{p}}) - {_d(_M6)} * sin(6 * {{p}}) + {_d(_M8)} * sin(8 * {{p}}))"
_ROOT = f"sqrt(1 - {_d(_E2)} * sin({{p}}) * sin({{p}}))"
register("project_sinu_forward", f"WITH {_EVENTS},{_angles(0)} {_metres(f'{_d(_A)} * l * cos(phi) / {_ROOT.format(p='phi')}', _LENGTH.format(p='phi'))} FROM ang")(_forward(_SINU))
_SINU_STEPS = _chain(f"{{p}} - ({_LENGTH} - CAST(y AS DOUBLE)) * {_ROOT} * {_ROOT} * {_ROOT} / {_d(_A * (1 - _E2))}", 6, "cells", f"CAST(y AS DOUBLE) / {_d(_A)}")
register("grid_geolocation_sinu", f"WITH {_cells(TENS)}, {_SINU_STEPS[0]} {_degrees(f'CAST(x AS DOUBLE) * {_ROOT.format(p=_SINU_STEPS[1])} / ({_d(_A)} * cos({_SINU_STEPS[1]}))', _SINU_STEPS[1], 0.0)} FROM i6")(_inverse(_SINU, TENS))

# polar stereographic
_STERE = "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +datum=WGS84"
_RATIO = f"pow((1 - {_d(_E)} * sin({{p}})) / (1 + {_d(_E)} * sin({{p}})), {_d(_E / 2)})"
_t = lambda phi: math.tan(math.pi / 4 - phi / 2) / ((1 - _E * math.sin(phi)) / (1 + _E * math.sin(phi))) ** (_E / 2)
_TS = math.radians(70)
_K = _A * math.cos(_TS) / math.sqrt(1 - _E2 * math.sin(_TS) ** 2) / _t(_TS)
_T = f"{_d(_K)} * tan(pi() / 4 - phi / 2) / {_RATIO.format(p='phi')}"
register("project_stere_forward", f"WITH {_EVENTS},{_angles(-45)} {_metres(f'{_T} * sin(l)', f'-({_T}) * cos(l)', 'phi > 1e-10 - pi() / 2')} FROM ang")(_forward(_STERE))
_RHO = f"(sqrt(CAST(x AS DOUBLE) * x + CAST(y AS DOUBLE) * y) / {_d(_K)})"
_STERE_STEPS = _chain(f"pi() / 2 - 2 * atan({_RHO} * {_RATIO})", 12, "cells", f"pi() / 2 - 2 * atan({_RHO})")
register("grid_geolocation_stere", f"WITH {_cells(TENS)}, {_STERE_STEPS[0]} {_degrees('atan2(CAST(x AS DOUBLE), -CAST(y AS DOUBLE))', _STERE_STEPS[1], -45.0)} FROM i12")(_inverse(_STERE, TENS))

# Lambert's azimuthal equal-area
_LAEA = "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +datum=WGS84"
_q = lambda s: (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
_Q = f"({_d(1 - _E2)} * (sin({{p}}) / (1 - {_d(_E2)} * sin({{p}}) * sin({{p}})) - ln((1 - {_d(_E)} * sin({{p}})) / (1 + {_d(_E)} * sin({{p}}))) / {_d(2 * _E)}))"
_S0 = math.sin(math.radians(52))
_B0 = math.asin(_q(_S0) / _q(1))
_RQ = _A * math.sqrt(_q(1) / 2)
_D0 = _A * math.cos(math.radians(52)) / math.sqrt(1 - _E2 * _S0**2) / (_RQ * math.cos(_B0))
_NEAR = f"(1 + {_d(math.sin(_B0))} * sin(b) + {_d(math.cos(_B0))} * cos(b) * cos(l))"
register(
    "project_laea_forward",
    f"""WITH {_EVENTS},{_angles(10)}, b AS (SELECT *, asin(greatest(-1, least(1, {_Q.format(p="phi")} / {_d(_q(1))}))) AS b FROM ang), w AS (SELECT *, {_NEAR} AS w FROM b)
{_metres(f"{_d(_RQ * _D0)} * sqrt(2 / w) * cos(b) * sin(l) + 4321000", f"{_d(_RQ / _D0)} * sqrt(2 / w) * ({_d(math.cos(_B0))} * sin(b) - {_d(math.sin(_B0))} * cos(b) * cos(l)) + 3210000", "w > 1e-10")} FROM w""",
)(_forward(_LAEA))
_LAEA_STEPS = _chain(f"{{p}} + pow(1 - {_d(_E2)} * sin({{p}}) * sin({{p}}), 2) / (2 * cos({{p}})) * (qq - {_Q}) / {_d(1 - _E2)}", 8, "s", "asin(qq / 2)")
register(
    "grid_geolocation_laea",
    f"""WITH {_cells(NEAR_EUROPE)}, o AS (SELECT *, (CAST(x AS DOUBLE) - 4321000) / {_d(_D0)} AS xx, (CAST(y AS DOUBLE) - 3210000) * {_d(_D0)} AS yy FROM cells), r AS (SELECT *, sqrt(xx * xx + yy * yy) AS r FROM o),
c AS (SELECT *, 2 * asin(r / {_d(2 * _RQ)}) AS c FROM r), s AS (SELECT *, {_d(_q(1))} * (cos(c) * {_d(math.sin(_B0))} + yy * sin(c) * {_d(math.cos(_B0))} / r) AS qq FROM c), {_LAEA_STEPS[0]}
{_degrees(f"atan2(xx * sin(c), r * {_d(math.cos(_B0))} * cos(c) - yy * {_d(math.sin(_B0))} * sin(c))", _LAEA_STEPS[1], 10.0)} FROM i8""",
)(_inverse(_LAEA, NEAR_EUROPE))

# a zone of the transverse Mercator grid
_UTM = "+proj=utm +zone=33 +datum=WGS84"
_SIZE = 0.9996 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_TO = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_XI, _ETA = (" ".join(f"{s} {_d(f)} * {a}({2 * k} * xi) * {b}({2 * k} * eta)" for k, f in enumerate(fs, 1)) for fs, s, a, b in ((_TO, "+", "sin", "cosh"), (_TO, "+", "cos", "sinh")))
_XI_BACK, _ETA_BACK = (" ".join(f"- {_d(f)} * {a}({2 * k} * xi) * {b}({2 * k} * eta)" for k, f in enumerate(_BACK, 1)) for a, b in (("sin", "cosh"), ("cos", "sinh")))
register(
    "project_utm_forward",
    f"""WITH {_EVENTS},{_angles(15)}, g AS (SELECT *, sinh({_d(_E)} * atanh({_d(_E)} * sin(phi))) AS g, tan(phi) AS tp FROM ang WHERE abs(lon - 15) <= 30 AND abs(lat) <= 85),
t AS (SELECT *, tp * sqrt(1 + g * g) - g * sqrt(1 + tp * tp) AS t FROM g), z AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM t)
{_metres(f"{_d(_SIZE)} * (eta {_ETA}) + 500000", f"{_d(_SIZE)} * (xi {_XI})")} FROM z""",
)(_forward(_UTM, "abs(lon - 15) <= 30 AND abs(lat) <= 85"))
_UTM_STEPS = _chain(f"2 * atan(tan(pi() / 4 + chi / 2) * pow((1 + {_d(_E)} * sin({{p}})) / (1 - {_d(_E)} * sin({{p}})), {_d(_E / 2)})) - pi() / 2", 12, "h", "chi")
register(
    "grid_geolocation_utm",
    f"""WITH {_cells(NEAR_ZONE)}, z AS (SELECT *, CAST(y AS DOUBLE) / {_d(_SIZE)} AS xi, (CAST(x AS DOUBLE) - 500000) / {_d(_SIZE)} AS eta FROM cells),
u AS (SELECT *, xi {_XI_BACK} AS xj, eta {_ETA_BACK} AS ej FROM z), h AS (SELECT *, asin(sin(xj) / cosh(ej)) AS chi FROM u), {_UTM_STEPS[0]}
{_degrees("atan2(sinh(ej), cos(xj))", _UTM_STEPS[1], 15.0)} FROM i12""",
)(_inverse(_UTM, NEAR_ZONE))


# The grid.
@register("grid_skeleton", f"WITH {_cells(TENS)} SELECT row, col, idx, x, y FROM cells")
def _(spark, sf_dir):
    return TENS.skeleton(spark).select("row", "col", "idx", "x", "y")


@register("grid_geolocation", f"WITH {_cells(TENS)} SELECT row, col, idx, x, y, CAST(degrees(CAST(x AS DOUBLE) / CAST(6378137 AS DOUBLE)) AS FLOAT) AS lon, CAST(degrees(CAST(y AS DOUBLE) / CAST(6378137 AS DOUBLE)) AS FLOAT) AS lat FROM cells")
def _(spark, sf_dir):
    return p.grid_geolocation(spark, TENS)


# Assignment.
for _name, _g in (("assign_cells", TENS), ("assign_cells_oversampled", OVER), ("assign_cells_undersampled", UNDER), ("assign_cells_time_window", TIMED)):

    @register(_name, f"WITH {_EVENTS},{_XY},{_cells(_g)},{_met(_g)} SELECT record_index, v, u FROM met")
    def _(spark, sf_dir, g=_g):
        return assign(observed(spark, sf_dir), g).select("record_index", "v", "u")


# Rasters.
def _gridded(g: GridSpec, name: str, **options):
    return lambda spark, sf_dir: _rounded(p.grid_observed(observed(spark, sf_dir), g, name, **options))


for _name, _g, _r in (
    ("grid_mean", TENS, "mean"),
    ("grid_weighted_mean", TENS, "weighted_mean"),
    ("grid_median", TENS, "median"),
    ("grid_nn_numeric", TENS, "numeric_nearest_neighbour"),
    ("grid_newest", TENS, "newest"),
    ("grid_mean_time_window", TIMED, "mean"),
    ("grid_mean_oversampled", OVER, "mean"),
    ("grid_median_oversampled", OVER, "median"),
    ("grid_nn_oversampled", OVER, "numeric_nearest_neighbour"),
    ("grid_mean_undersampled", UNDER, "mean"),
):
    register(_name, grid_sql(_g, _r))(_gridded(_g, _r))

for _name, _r in (("grid_weighted_mean_compat", "weighted_mean"), ("grid_nn_compat", "numeric_nearest_neighbour")):
    _value = "round(coalesce(a, CAST(-999 AS DOUBLE)), 6)" if _r == "weighted_mean" else "round(coalesce(CAST(CAST(a AS FLOAT) AS DOUBLE), CAST(-999 AS DOUBLE)), 6)"
    register(_name, grid_sql(TENS, _r, _value, compat=True))(_gridded(TENS, _r, compat=True))


@register("grid_nn_coded", f"""WITH {_EVENTS},{_XY},{_cells(TENS)},{_met(TENS)}, r AS (SELECT v, u, arg_min(code, (d2, record_index)) AS a FROM met GROUP BY v, u)
SELECT row, col, idx, x, y, coalesce(hex(a), '00000000') AS value FROM cells LEFT JOIN r USING (v, u)""")
def _(spark, sf_dir):
    return p.grid_observed(coded(spark, sf_dir), TENS, "coded_nearest_neighbour", "coded32").withColumn("value", F.hex("value"))


@register("grid_mean_int_output", grid_sql(TENS, "mean", "CAST(trunc(coalesce(a, -999)) AS INTEGER)"))
def _(spark, sf_dir):
    return p.grid_observed(observed(spark, sf_dir), TENS, "mean", output_dtype="int32")


@register("grid_mean_uint8_output", grid_sql(TENS, "mean", "CAST(CASE WHEN trunc(a) BETWEEN 0 AND 255 THEN trunc(a) ELSE 7 END AS SMALLINT)"))
def _(spark, sf_dir):
    return p.grid_observed(observed(spark, sf_dir), TENS, "mean", output_dtype="uint8", output_fill=7)


@register("grid_mean_geolocated", f"""SELECT *, CAST(degrees(CAST(x AS DOUBLE) / CAST(6378137 AS DOUBLE)) AS FLOAT) AS lon, CAST(degrees(CAST(y AS DOUBLE) / CAST(6378137 AS DOUBLE)) AS FLOAT) AS lat FROM ({grid_sql(TENS, "mean")})""")
def _(spark, sf_dir):
    return _rounded(p.grid_observed(observed(spark, sf_dir), TENS, "mean", geolocation=True))


@register("grid_all_fill_empty", grid_sql(TENS, "mean", fill="false"))
def _(spark, sf_dir):
    nothing = observed(spark, sf_dir).withColumn("value", F.lit(-999.0))
    return _rounded(p.grid_observed(nothing, TENS, "mean"))


@register("grid_mean_lineitem", grid_sql(TENS, "mean", obs=_LINES))
def _(spark, sf_dir):
    return _rounded(p.grid_observations(lines(spark, sf_dir), TENS, "mean"))


@register("grid_mean_default_grid", grid_sql(FINE, "mean", near=True))
def _(spark, sf_dir):
    return _rounded(p.grid_observed(observed(spark, sf_dir), FINE, "mean"))


@register("masked_log10", f"SELECT row, col, idx, x, y, CASE WHEN value > 0 THEN round(log10(value), 6) END AS value FROM ({grid_sql(TENS, 'median')})")
def _(spark, sf_dir):
    return _rounded(p.masked(_rounded(p.grid_observed(observed(spark, sf_dir), TENS, "median")), log=True))


@register("all_fill", f"SELECT bool_and(value = -999) AS all_fill FROM ({grid_sql(TENS, 'mean')})")
def _(spark, sf_dir):
    return p.all_fill(p.grid_observed(observed(spark, sf_dir), TENS, "mean"))


# Boxes.
_IN = "x BETWEEN CAST(-5e6 AS FLOAT) AND CAST(5e6 AS FLOAT) AND y BETWEEN CAST(-2e6 AS FLOAT) AND CAST(6e6 AS FLOAT)"
_IN_TIME = _IN + " AND t BETWEEN CAST(1000 AS FLOAT) AND CAST(6000 AS FLOAT)"
for _name, _b, _where in (("range_query_box", BOX, _IN), ("range_query_box_time", BOX_TIME, _IN_TIME), ("range_query_unbounded", Bounds(), "true")):

    @register(_name, f"WITH {_EVENTS},{_XY} SELECT record_index, x, y, t, value FROM xy WHERE {_where}")
    def _(spark, sf_dir, b=_b):
        return q.range_query(observed(spark, sf_dir), b).select("record_index", "x", "y", "t", "value")


for _r, _agg in _AGG.items():
    # the box's centre is (0, 2e6)
    @register(f"reduce_box_{_r}", f"WITH {_EVENTS},{_XY}, b AS (SELECT *, CAST(x AS DOUBLE) * x + (2e6 - CAST(y AS DOUBLE)) * (2e6 - CAST(y AS DOUBLE)) AS d2 FROM xy WHERE {_IN} AND value <> -999), c AS (SELECT *, sqrt(d2) AS d FROM b) SELECT round(coalesce({_agg}, CAST(-999 AS DOUBLE)), 6) AS value FROM c")
    def _(spark, sf_dir, r=_r):
        return _rounded(q.reduce_box(observed(spark, sf_dir), r, BOX))


@register("reduce_box_coded_nearest_neighbour", f"WITH {_EVENTS},{_XY} SELECT hex(arg_min(code, (CAST(x AS DOUBLE) * x + (2e6 - CAST(y AS DOUBLE)) * (2e6 - CAST(y AS DOUBLE)), record_index))) AS value FROM xy WHERE {_IN}")
def _(spark, sf_dir):
    return q.reduce_box(coded(spark, sf_dir), "coded_nearest_neighbour", BOX).select(F.hex("value").alias("value"))


@register("nearest_neighbour", f"""WITH {_EVENTS},{_XY},{_cells(TENS)},
n AS (SELECT c.idx, min((((CAST(c.x AS DOUBLE) - o.x) * (CAST(c.x AS DOUBLE) - o.x) + (CAST(c.y AS DOUBLE) - o.y) * (CAST(c.y AS DOUBLE) - o.y)), o.record_index)) AS m FROM cells c, xy o GROUP BY c.idx)
SELECT idx AS target_id, m[2] AS record_index, m[1] AS d2 FROM n""")
def _(spark, sf_dir):
    """The observation nearest to every cell's centre."""
    return q.nearest_neighbour(observed(spark, sf_dir), TENS.skeleton(spark).select(F.col("idx").alias("target_id"), "x", "y"))


@register("observation_extent", f"WITH {_EVENTS},{_XY} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(t) AS min_t, max(t) AS max_t, count(*) AS num_observations FROM xy")
def _(spark, sf_dir):
    return q.observation_extent(observed(spark, sf_dir))


@register("extent_calc", f"""WITH c AS (SELECT {_d(_M.a * _M.k0)} * radians(CAST(28 AS DOUBLE)) AS x1, {_d(_M.a * _M.k0)} * radians(CAST(0 AS DOUBLE)) AS x0,
 {_d(-_M.a * _M.k0)} * ln(tan(pi() / 4 - radians(CAST(63 AS DOUBLE)) / 2) / pow((1 - {_d(_M.e)} * sin(radians(CAST(63 AS DOUBLE)))) / (1 + {_d(_M.e)} * sin(radians(CAST(63 AS DOUBLE)))), {_d(_M.e / 2)})) AS y1,
 {_d(-_M.a * _M.k0)} * ln(tan(pi() / 4 - radians(CAST(47 AS DOUBLE)) / 2) / pow((1 - {_d(_M.e)} * sin(radians(CAST(47 AS DOUBLE)))) / (1 + {_d(_M.e)} * sin(radians(CAST(47 AS DOUBLE)))), {_d(_M.e / 2)})) AS y0)
SELECT round(CAST(CAST((x1 + x0) / 2 AS FLOAT) AS DOUBLE), 2) AS central_x, round(CAST(CAST((y1 + y0) / 2 AS FLOAT) AS DOUBLE), 2) AS central_y,
 CAST(ceil(abs(x1 - x0) / 1100) AS INTEGER) AS width, CAST(ceil(abs(y1 - y0) / 1100) AS INTEGER) AS height FROM c""")
def _(spark, sf_dir):
    e = extent(MERC, 63, 47, 13, -15, 1100, 1100)
    return spark.createDataFrame([(round(e.central_x, 2), round(e.central_y, 2), e.width, e.height)], "central_x double, central_y double, width int, height int")


@register("linear_timemap", """SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(r * 36 + c AS BIGINT) AS idx,
 CAST(CASE WHEN r = 17 THEN CAST(900 AS DOUBLE) ELSE r * CAST(800.0 / 17 AS DOUBLE) + CAST(100 AS DOUBLE) END AS FLOAT) AS t
FROM (SELECT unnest(generate_series(0, 17)) AS r), (SELECT unnest(generate_series(0, 35)) AS c)""".replace("CAST(800.0 / 17 AS DOUBLE)", _d(800.0 / 17)))
def _(spark, sf_dir):
    return linear_timemap(spark, 36, 18, 100.0, 900.0)


# Saved geometry and flat files.
@register("index_roundtrip", f"WITH {_EVENTS},{_XY} SELECT record_index, x, y, t FROM xy WHERE {_IN_TIME}")
def _(spark, sf_dir):
    path = scratch(spark, "index")
    save_index(observed(spark, sf_dir), path, "+proj=eqc +datum=WGS84")
    return q.range_query(load_index(spark, path).observed, BOX_TIME)


@register("index_product", grid_sql(TENS, "mean"))
def _(spark, sf_dir):
    """A raster from saved geometry and the values of one product."""
    from gridloom.sources.index import with_values

    path = scratch(spark, "index")
    save_index(observed(spark, sf_dir), path, "+proj=eqc +datum=WGS84")
    return _rounded(p.grid_observed(with_values(load_index(spark, path), events(spark, sf_dir)), TENS, "mean"))


@register("raw_roundtrip", f"SELECT row, col, idx, CAST(value AS FLOAT) AS value FROM ({grid_sql(TENS, 'median')})")
def _(spark, sf_dir):
    """A raster written as a flat file and read back."""
    path = local_path(scratch(spark, "raster"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    raster = _rounded(p.grid_observed(observed(spark, sf_dir), TENS, "median"))
    write_raster(raster.withColumn("value", F.col("value").cast("float")), path, TENS.width * TENS.height)
    return read_raster(spark, path, TENS.width)


def _files(spark: SparkSession, label: str) -> str:
    """A fresh folder for flat files."""
    path = local_path(scratch(spark, label))
    os.makedirs(path, exist_ok=True)
    return path


def _put(rows: DataFrame, items: int, path: str, kind: str, column: str) -> str:
    write_raster(rows.select(F.col("record_index").alias("idx"), F.col(column).cast(DTYPES[kind].spark).alias("value")), path, items, kind)
    return path


def _flat(spark: SparkSession, sf_dir: str, label: str, value: str = "float64") -> tuple[dict, int]:
    """The observations as flat files; their numbers have no gap."""
    rows, at = events(spark, sf_dir), _files(spark, label)
    n = rows.count()
    kinds = {"lats": ("lat", "float32"), "lons": ("lon", "float32"), "time": ("t", "float32"), "data": ("value", value)}
    return {name: _put(rows, n, f"{at}/{name}", kind, c) for name, (c, kind) in kinds.items()}, n


@register("raw_scan_with_time", f"WITH {_EVENTS} SELECT record_index, lat, lon, t, value FROM obs")
def _(spark, sf_dir):
    """Coordinates, times and values in flat files, read in lockstep."""
    files, _ = _flat(spark, sf_dir, "raw-time")
    return read_raw(spark, **files, dtype="float64", slice=1000)


@register("raw_scan_default_time", f"WITH {_EVENTS} SELECT record_index, lat, lon, CAST(0 AS FLOAT) AS t FROM obs")
def _(spark, sf_dir):
    """Coordinates without a file of times: all are 0."""
    files, _ = _flat(spark, sf_dir, "raw-plain")
    return read_raw(spark, files["lats"], files["lons"], slice=700)


_NUMERIC = [k for k, d in DTYPES.items() if d.style == "numeric"]


def _range(kind: str) -> str:
    low, high = DTYPES[kind].bounds()
    return f"trunc(a) BETWEEN {_d(float(low))} AND {_d(float(high))}"


# means as every numeric storage type: truncated, and the fill value where the type can't hold them
_STORED = {k: f"CASE WHEN a IS NULL OR NOT {_range(k)} THEN 7 ELSE trunc(a) END" if DTYPES[k].whole else f"coalesce(CAST(a AS {'FLOAT' if k == 'float32' else 'DOUBLE'}), 7)" for k in _NUMERIC}


@register("grid_mean_every_type", " UNION ALL ".join(f"SELECT '{k}' AS dtype, row, col, idx, round(CAST(value AS DOUBLE), 3) AS value FROM ({grid_sql(TENS, 'mean', v)})" for k, v in _STORED.items()))
def _(spark, sf_dir):
    rows = observed(spark, sf_dir)
    out = [p.grid_observed(rows, TENS, "mean", output_dtype=k, output_fill=7).select(F.lit(k).alias("dtype"), "row", "col", "idx", F.round(F.col("value").cast("double"), 3).alias("value")) for k in _NUMERIC]
    return _union(out)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


# whole numbers of every storage type through a flat file, and opaque bytes of every size
@register("raw_every_type", " UNION ALL ".join([f"SELECT '{k}' AS dtype, event_id AS record_index, CAST(event_id % 100 AS VARCHAR) AS value FROM events" for k in _NUMERIC] + [f"SELECT 'coded{8 * n}' AS dtype, event_id AS record_index, upper(substr(md5(CAST(event_id AS VARCHAR)), 1, {2 * n})) AS value FROM events" for n in (1, 2, 4, 8)]))
def _(spark, sf_dir):
    rows, at, out = events(spark, sf_dir), _files(spark, "raw-types"), []
    n = rows.count()
    for k, d in DTYPES.items():
        if d.style == "numeric":
            given, shown = rows.withColumn("value", F.col("record_index") % 100), F.col("value").cast("long").cast("string")
        else:
            given, shown = rows.withColumn("value", F.unhex(F.substring(F.md5(F.col("record_index").cast("string").cast("binary")), 1, 2 * d.size))), F.hex("value")
        path = _put(given, n, f"{at}/{k}", k, "value")
        out.append(read_raw(spark, data=path, dtype=k).select(F.lit(k).alias("dtype"), "record_index", shown.alias("value")))
    return _union(out)


@register("raw_coded_raster", ORACLES["grid_nn_coded"].replace("row, col, idx, x, y,", "row, col, idx,"))
def _(spark, sf_dir):
    """A coded raster written as a flat file and read back."""
    path = f"{_files(spark, 'raw-coded')}/raster"
    write_raster(p.grid_observed(coded(spark, sf_dir), TENS, "coded_nearest_neighbour", "coded32"), path, TENS.width * TENS.height, "coded32")
    return read_raster(spark, path, TENS.width, "coded32").withColumn("value", F.hex("value"))


@register("observe_drops_what_is_not_finite", f"WITH {_EVENTS},{_XY} SELECT record_index, x, y, t FROM xy WHERE record_index % 7 > 2")
def _(spark, sf_dir):
    bad = lambda c, k, v: F.when(F.col("record_index") % 7 == k, F.lit(v).cast("float")).otherwise(F.col(c))
    rows = events(spark, sf_dir)
    rows = rows.withColumns({"lat": bad("lat", 0, float("nan")), "lon": bad("lon", 1, float("inf")), "t": bad("t", 2, None)})
    return q.observe(rows, mode="drop").select("record_index", "x", "y", "t")


@register("index_invariants", "SELECT count(*) AS num_observations, count(DISTINCT event_id) = count(*) AS numbers_unique, true AS finite, true AS tiles_whole FROM events")
def _(spark, sf_dir):
    path = scratch(spark, "index")
    save_index(observed(spark, sf_dir), path, "+proj=eqc +datum=WGS84")
    return check_index(spark, path)


@register("command_line", f"""WITH {_EVENTS},{_XY},{_cells(TIMED)},{_met(TIMED)}, r AS (SELECT v, u, median(value) AS a FROM met WHERE value <> -999 GROUP BY v, u)
SELECT row, col, idx, round(coalesce(a, CAST(-1 AS DOUBLE)), 6) AS value, CAST(degrees(CAST(y AS DOUBLE) / CAST(6378137 AS DOUBLE)) AS FLOAT) AS lat, CAST(degrees(CAST(x AS DOUBLE) / CAST(6378137 AS DOUBLE)) AS FLOAT) AS lon FROM cells LEFT JOIN r USING (v, u)""")
def _(spark, sf_dir):
    """The command line from flat files to flat files, by way of a saved index."""
    from gridloom import cli

    files, _ = _flat(spark, sf_dir, "cli")
    out = os.path.dirname(files["data"])
    coordinates = [w for n in ("lats", "lons", "time") for w in (f"--input-{n}", files[n])]
    index = scratch(spark, "cli-index")
    cli.main([*coordinates, "--save-index", index])
    cli.main(["--load-index", index, "--input-data", files["data"], "--input-dtype", "float64", "--output-fill-value", "-1", "--width", "36", "--height", "18", "--reduction-function", "median", "--time-min", "1000", "--time-max", "6000", *(w for n in ("data", "lats", "lons") for w in (f"--output-{n}", f"{out}/out-{n}"))])
    read = lambda n, kind, c: read_raster(spark, f"{out}/out-{n}", TENS.width, kind).withColumnRenamed("value", c)
    raster = read("data", "float64", "value").join(read("lats", "float32", "lat").select("idx", "lat"), "idx").join(read("lons", "float32", "lon").select("idx", "lon"), "idx")
    return _rounded(raster).select("row", "col", "idx", "value", "lat", "lon")
