import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DTYPES, dtype, representable, stored
from gridloom.functions.projection import Projection, extent, register_projection
from gridloom.functions.reductions import reduction, reductions, register_reduction
from gridloom.plans.gridspec import Bounds, GridSpec


def test_dtypes():
    assert len(DTYPES) == 14
    assert dtype("uint8").size == 1 and dtype("uint8").style == "numeric"
    assert dtype("coded64").size == 8 and dtype("coded64").spark == "binary"
    with pytest.raises(ValueError):
        dtype("int7")
    assert not representable(-999, dtype("uint16")) and representable(-999, dtype("int16")) and representable(-999, dtype("float32"))


def test_stored_truncates_and_fills(spark):
    rows = spark.createDataFrame([(2.9,), (-2.9,), (300.0,), (-129.0,), (None,), (float("nan"),), (1e300,), (127.999,)], "v double")
    got = [r[0] for r in rows.select(stored(F.col("v"), dtype("int8"), -7)).collect()]
    assert got == [2, -2, -7, -7, -7, -7, -7, 127]
    wide = spark.createDataFrame([(1.8446744073709550e19,), (9.2e18,), (-1.0,)], "v double")
    assert [int(r[0]) for r in wide.select(stored(F.col("v"), dtype("uint64"), 5)).collect()] == [5 if 1.8446744073709550e19 > 2**64 - 1 else int(1.8446744073709550e19), 9200000000000000000, 5]
    assert [r[0] for r in rows.select(stored(F.col("v"), dtype("float64"), -1.5)).limit(5).collect()][-1] == -1.5
    with pytest.raises(ValueError):
        stored(F.col("v"), dtype("uint8"), -999)
    with pytest.raises(ValueError):
        stored(F.col("v"), dtype("coded8"), 0)


def point(spark, p, lon, lat):
    df = spark.createDataFrame([(lon, lat)], "lon float, lat float")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    xy = df.select(x.alias("x"), y.alias("y"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    return xy.select("x", "y", lon, lat).first()


def test_eqc_goldens(spark):
    x, y, lon, lat = point(spark, Projection.parse("+proj=eqc +datum=WGS84"), 45.0, 30.0)
    assert (x, y, lon, lat) == (5009377.0, 3339584.75, 45.0, 30.0)


@pytest.mark.parametrize("lon,lat", [(-15.0, 0.0), (13.0, 63.0), (-179.0, -80.5), (170.0, 45.25)])
def test_mercator_goes_there_and_back(spark, lon, lat):
    p = Projection.parse("+proj=merc +ellps=WGS84 +lat_ts=55.0 +lon_0=-15.0")
    x, y, lon2, lat2 = point(spark, p, lon, lat)
    px, py = p.forward_point(lon, lat)
    assert x == pytest.approx(px, abs=2) and y == pytest.approx(py, abs=2)
    assert (lon2 - lon) % 360 == pytest.approx(0, abs=2e-5) or (lon2 - lon) % 360 == pytest.approx(360, abs=2e-5)
    assert lat2 == pytest.approx(lat, abs=2e-5)


def test_outside_the_domain_is_infinite(spark):
    for p, lat in (("+proj=merc", 90.0), ("+proj=merc", -90.0), ("+proj=eqc", 95.0)):
        assert point(spark, Projection.parse(p), 0.0, lat)[1] == math.inf


@pytest.mark.parametrize("bad", ["", "proj=eqc", "+proj=nope", "+proj=eqc +wrong=1", "+proj=merc +lat_ts=x", "+proj=eqc +ellps=none", "+proj=merc +lat_ts=90", "+proj=utm +zone=61", "+proj=lcc +lat_1=10 +lat_2=-10", "+proj=stere +lat_0=91", "+proj=sinu +k_0=x"])
def test_bad_projections(bad):
    with pytest.raises(ValueError):
        Projection.parse(bad)


# Worked examples that the public EPSG guidance prints.
@pytest.mark.parametrize(
    "definition,lon,lat,x,y",
    [
        ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", 5, 50, 3962799.45, 2999718.85),
        ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000", 120, -75, 7255380.79, 7053389.56),
        ("+proj=utm +zone=33", 15, 45, 500000.0, 4982950.40),
        ("+proj=utm +lon_0=16 +south", 15, 0, 500000.0, 10000000.0),
        ("+proj=longlat", 90, 45, math.pi / 2, math.pi / 4),
        ("+proj=sinu +R=1", 90, 60, math.pi / 4, math.pi / 3),
        ("+proj=cea +R=1", 90, 30, math.pi / 2, 0.5),
    ],
)
def test_projection_examples(definition, lon, lat, x, y):
    assert Projection.parse(definition).forward_point(lon, lat) == pytest.approx((x, y), abs=0.01)


_ALL = ["sinu", "sinu +R=6371000", "stere +lat_0=90 +lat_ts=70 +lon_0=-45", "stere +lat_0=-90 +k_0=0.994", "stere +lat_0=52 +lon_0=5", "laea +lat_0=90", "laea +lat_0=-90 +R=6371228", "laea +lat_0=0", "cea +lat_ts=30", "lcc +lat_1=33 +lat_2=45 +lat_0=40 +lon_0=-97", "lcc +lat_1=-30 +lat_2=-60", "tmerc +lon_0=9 +k=0.9996", "utm +zone=33", "longlat"]


def test_projections_go_there_and_back(spark):
    """Places near and far, on the driver, in the plan and back."""
    for definition in _ALL:
        p = Projection.parse(f"+proj={definition}")
        near = [(p.lon_0 + a, b) for a in (-40.0, 0.0, 25.5) for b in (-60.0, -10.0, 0.0, 45.0, 80.0)]
        df = spark.createDataFrame(near, "lon double, lat double")
        x, y = p.forward(F.col("lon"), F.col("lat"))
        rows = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        lon, lat = p.inverse(F.col("x"), F.col("y"))
        for r in rows.select("lon", "lat", "x", "y", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert (r.x, r.y) == pytest.approx(p.forward_point(r.lon, r.lat), abs=4, rel=1e-6), definition
            assert abs((r.lon2 - r.lon + 180) % 360 - 180) * math.cos(math.radians(r.lat)) < 1e-3 and abs(r.lat2 - r.lat) < 1e-3, (definition, r)


def test_places_outside_a_domain(spark):
    for definition, lon, lat in (("stere +lat_0=90", 0.0, -90.0), ("laea +lat_0=0", 180.0, 0.0), ("stere +lat_0=10", 180.0, -10.0), ("utm +zone=31", 100.0, 10.0), ("lcc +lat_1=50", 0.0, -90.0), ("sinu", 0.0, 91.0)):
        p = Projection.parse(f"+proj={definition}")
        assert point(spark, p, lon, lat)[:2] == (math.inf, math.inf) and p.forward_point(lon, lat) == (math.inf, math.inf), definition
    lon, lat = Projection.parse("+proj=laea").inverse(F.lit(2e7), F.lit(0.0))
    far = spark.range(1).select(lon, lat).first()
    assert all(v is None or math.isnan(v) for v in far)


def test_a_registered_projection(spark):
    register_projection("shrunk", lambda numbers, a, e: {"k": numbers.get("shrink", 1.0)}, lambda m, c, lam, phi: (lam / c.k, m.sin(phi) / c.k, m.true(phi)), lambda m, c, x, y: (x * c.k, m.asin(y * c.k)), ("shrink",))
    p = Projection.parse("+proj=shrunk +shrink=2 +x_0=1")
    x, y, lon, lat = point(spark, p, 90.0, 30.0)
    assert (x, y, lon, lat) == pytest.approx((1 + math.pi / 4, 0.25, 90.0, 30.0), abs=1e-5)
    with pytest.raises(ValueError):
        register_projection("broken", None, None, None)
    with pytest.raises(ValueError):
        Projection.parse("+proj=sinu +shrink=2")


def test_extent_golden():
    e = extent("+proj=merc +ellps=WGS84 +lat_ts=55.0 +lon_0=-15.0", 63, 47, 13, -15, 1100, 1100)
    assert (round(e.central_x, 4), round(e.central_y, 1), e.width, e.height) == (895917.8125, 4303742.5, 1629, 1647)
    with pytest.raises(ValueError):
        extent("+proj=merc", 90, 0, 1, 0, 10, 10)


def test_grid_spec():
    g = GridSpec(1000, 1000, 1.0, 1.0)
    assert g.h_offset == g.v_offset == 0.5 and g.time_min == -math.inf and g.time_max == math.inf
    assert GridSpec(1000, 1000, 1.0, 1.0, hsample=3.0).h_offset == 1.5
    d = GridSpec()
    assert (d.width, d.height) == (720, 360) and d.hres == float(np.float32(40075017.0 / 720))
    for bad in ({"width": 0}, {"height": -1}, {"hres": 0}, {"vsample": -1.0}, {"vres": math.nan}, {"time_min": math.nan}, {"central_x": math.inf}):
        with pytest.raises(ValueError):
            GridSpec(**bad)


def test_bounds():
    with pytest.raises(ValueError):
        Bounds(x_lo=math.nan).predicate()


def test_registry(spark):
    assert {"mean", "weighted_mean", "median", "coded_nearest_neighbour", "numeric_nearest_neighbour", "newest"} <= set(reductions())
    with pytest.raises(ValueError):
        reduction("nope")
    with pytest.raises(ValueError):
        register_reduction("x", "nope", lambda o: o.value)
    register_reduction("largest", "numeric", lambda o: F.max(o.value))
    assert reduction("largest").style == "numeric"
