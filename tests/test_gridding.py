import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import query as q
from gridloom.operators.assign import assign
from gridloom.plans.gridspec import Bounds, GridSpec
from gridloom.plans.pipeline import all_fill, grid_geolocation, grid_observations, grid_observed, masked, to_masked_numpy

f32 = np.float32
SCHEMA = "record_index long, x float, y float, t float, value double"


def fixture(spark):
    return spark.createDataFrame([(i, float(i), float(i + 1), float(i + 2), -999.0 if i % 4 == 0 else 5.0 * i) for i in range(100)], SCHEMA)


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("name,expected", [("mean", 250.0), ("weighted_mean", 252.496750), ("median", 250.0), ("numeric_nearest_neighbour", 245.0), ("newest", 495.0)])
def test_reduction_goldens(spark, name, expected, compat):
    got = q.reduce_box(fixture(spark), name, Bounds(25, 75, 25, 75), restrict=False, compat=compat).first()[0]
    assert got == pytest.approx(expected, abs=1e-5)


def test_coded_golden(spark):
    rows = [(i, float(i), float(i + 1), float(i + 2), bytearray(f32(-999.0 if i % 4 == 0 else 5.0 * i).tobytes())) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA.replace("value double", "value binary"))
    got = q.reduce_box(df, "coded_nearest_neighbour", Bounds(25, 75, 25, 75), restrict=False).first()[0]
    assert np.frombuffer(bytes(got), f32)[0] == 245.0


@pytest.mark.parametrize("values,expected", [([3.14159], 3.14159), ([5.0, 1.0, 3.0], 3.0), ([5.0, 1.0, 3.0, 4.3, 2.8, 9.9], 3.65), ([], -999.0)])
def test_median_goldens(spark, values, expected):
    df = spark.createDataFrame([(k, 0.0, 0.0, 0.0, v) for k, v in enumerate(values)], SCHEMA)
    assert q.reduce_box(df, "median", Bounds()).first()[0] == pytest.approx(expected)


def brute(points, g):
    """Every cell against every point in 32-bit steps."""
    out = set()
    for axis_cells in [None]:
        cx = [f32(g.x_0 + (u + 0.5) * g.hres) for u in range(g.width)]
        cy = [f32(g.y_0 + (v + 0.5) * g.vres) for v in range(g.height)]
        ho, vo = f32(g.h_offset), f32(g.v_offset)
        for i, x, y in points:
            us = [u for u in range(g.width) if f32(cx[u] - ho) <= f32(x) <= f32(cx[u] + ho)]
            vs = [v for v in range(g.height) if f32(cy[v] - vo) <= f32(y) <= f32(cy[v] + vo)]
            out |= {(i, v, u) for u in us for v in vs}
    return out


@pytest.mark.parametrize("seed,sample", [(0, None), (1, 3.0), (2, 0.4), (3, 1.0), (4, 7.3)])
def test_assignment_matches_brute_force(spark, seed, sample):
    rng = random.Random(seed)
    w, h = rng.randrange(1, 40), rng.randrange(1, 40)
    hres, vres = rng.uniform(0.3, 90000), rng.uniform(0.3, 90000)
    g = GridSpec(w, h, hres, vres, rng.uniform(-1e6, 1e6), rng.uniform(-1e6, 1e6), None if sample is None else sample * hres, None if sample is None else sample * vres)
    points = [(k, float(f32(g.central_x + rng.uniform(-0.7, 0.7) * w * hres)), float(f32(g.central_y + rng.uniform(-0.7, 0.7) * h * vres))) for k in range(150)]
    # exactly on edges of boxes
    for k in range(150, 250):
        u, v = rng.randrange(w), rng.randrange(h)
        side = lambda c, o: float(f32(f32(c) + rng.choice([-1, 1]) * f32(o)))
        points.append((k, side(g.x_0 + (u + 0.5) * g.hres, g.h_offset), side(g.y_0 + (v + 0.5) * g.vres, g.v_offset)))
    points += [(900, math.inf, 0.0), (901, -math.inf, 0.0), (902, math.nan, 0.0), (903, 3e38, -3e38)]
    df = spark.createDataFrame(points, "record_index long, x float, y float")
    got = {(r.record_index, r.v, r.u) for r in assign(df, g).collect()}
    assert got == brute([p for p in points if all(map(math.isfinite, p))], g)


def test_no_theta_join_in_the_plan(spark):
    obs = fixture(spark)
    plan = grid_observed(obs, GridSpec(36, 18), "mean")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_empty_input_is_all_fill(spark):
    none = spark.createDataFrame([], SCHEMA)
    for name in ("mean", "median", "newest"):
        r = grid_observed(none, GridSpec(4, 3), name)
        assert r.count() == 12 and all_fill(r).first()[0]
    coded = none.withColumn("value", F.lit(None).cast("binary"))
    assert {bytes(r.value) for r in grid_observed(coded, GridSpec(2, 2), "coded_nearest_neighbour", "coded16").collect()} == {b"\0\0"}


def test_first_row_is_the_top(spark):
    g = GridSpec(2, 2, 10.0, 10.0)
    df = spark.createDataFrame([(0, -5.0, 5.0, 0.0, 1.0), (1, 5.0, -5.0, 0.0, 2.0)], SCHEMA)
    got = {(r.row, r.col): r.value for r in grid_observed(df, g, "mean").collect()}
    assert got == {(0, 0): 1.0, (0, 1): -999.0, (1, 0): -999.0, (1, 1): 2.0}


def test_ties_go_to_the_smallest_index(spark):
    df = spark.createDataFrame([(7, 1.0, 0.0, 5.0, 70.0), (3, -1.0, 0.0, 5.0, 30.0), (9, 0.0, 1.0, 5.0, 90.0)], SCHEMA)
    g = GridSpec(1, 1, 10.0, 10.0)
    assert grid_observed(df, g, "numeric_nearest_neighbour").first().value == 30.0
    assert grid_observed(df, g, "newest").first().value == 30.0


def test_fill_rules(spark):
    g = GridSpec(1, 1, 10.0, 10.0)
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, -1.0), (1, 0.0, 0.0, 0.0, 4.0), (2, 0.0, 0.0, 0.0, None)], SCHEMA)
    assert grid_observed(df, g, "mean", input_fill=-1).first().value == 4.0
    assert grid_observed(df.where("record_index = 0"), g, "mean", input_fill=-1, output_fill=8).first().value == 8.0
    assert grid_observed(df.where("record_index = 1"), g, "weighted_mean").first().value == -999.0  # all distances are 0
    nan = spark.createDataFrame([(0, 0.0, 0.0, 0.0, math.nan)], SCHEMA)
    assert grid_observed(nan, g, "mean", input_fill=math.nan).first().value == -999.0


def test_plan_time_errors(spark):
    df, g = fixture(spark), GridSpec(2, 2)
    for bad in ({"output_dtype": "uint8"}, {"input_dtype": "coded8"}, {"output_dtype": "nope"}):
        with pytest.raises(ValueError):
            grid_observed(df, g, "mean", **bad)
    with pytest.raises(ValueError):
        grid_observed(df, g, "coded_nearest_neighbour", "coded8", "coded16")
    with pytest.raises(ValueError):
        grid_observed(df, g, "nope")
    with pytest.raises(ValueError):
        assign(df.withColumn("u", F.lit(1)), g)


def test_observe_modes(spark):
    bad = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1.0), (1, math.nan, 2.0, 3.0, 1.0), (2, 1.0, None, 3.0, 1.0), (3, 1.0, 2.0, math.inf, 1.0)], "record_index long, lon float, lat float, t float, value double")
    assert [r.record_index for r in q.observe(bad, mode="drop").collect()] == [0]
    with pytest.raises(Exception, match="finite"):
        q.observe(bad).collect()
    assert q.observe(bad.drop("t").where("record_index = 0")).first().t == 0.0


def test_global_lattice(spark):
    n = 361 * 721
    rows = spark.range(n).select(F.col("id").alias("record_index"), (F.floor(F.col("id") / 721) / 2 - 90).cast("float").alias("lat"), (F.pmod("id", F.lit(721)) / 2 - 180).cast("float").alias("lon"), F.lit(1.0).alias("value"))
    o = q.observe(rows)
    assert n == 260281 and q.range_query(o, Bounds()).count() == n
    cells = assign(o, GridSpec())
    assert cells.where("y > 10002000 OR y < -10002000").count() == 0
    assert cells.select("record_index").distinct().count() > 0.85 * n


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_nearest_neighbour_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    points = [(k, rng.choice([0.0, rng.uniform(-1e5, 1e5)]), rng.gauss(0, 1e4 if seed else 1.0)) for k in range(300)]
    targets = [(k, rng.uniform(-3e5, 3e5), rng.uniform(-3e5, 3e5)) for k in range(40)]
    f = lambda v: float(f32(v))
    got = {r.target_id: r.record_index for r in q.nearest_neighbour(spark.createDataFrame(points, "record_index long, x float, y float"), spark.createDataFrame(targets, "target_id long, x float, y float")).collect()}
    for k, x, y in targets:
        assert got[k] == min(((f(x) - f(a)) ** 2 + (f(y) - f(b)) ** 2, i) for i, a, b in points)[1]
    none = q.nearest_neighbour(spark.createDataFrame([], "record_index long, x float, y float"), spark.createDataFrame(targets[:1], "target_id long, x float, y float"))
    assert none.first().record_index is None


def test_masked_and_geolocation(spark):
    df = spark.createDataFrame([(0, 100.0), (1, -999.0), (2, 0.0)], "idx long, value double")
    assert [r.value for r in masked(df, log=True).orderBy("idx").collect()] == [2.0, None, None]
    g = {(r.row, r.col): (r.lon, r.lat) for r in grid_geolocation(spark, GridSpec(4, 2)).collect()}
    assert g[(0, 0)][0] == pytest.approx(-135, abs=0.01) and g[(0, 0)][1] == pytest.approx(45, abs=0.2)


def test_streaming_mean(spark, tmp_path):
    from gridloom.streaming.incremental import streaming_mean

    fixture(spark).write.parquet(str(tmp_path / "in"))
    g = GridSpec(4, 4, 50.0, 50.0, 50.0, 50.0)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    s = streaming_mean(stream, g).writeStream.outputMode("complete").format("memory").queryName("means").start()
    s.processAllAvailable()
    s.stop()
    got = {(r.v, r.u): r.value for r in spark.sql("SELECT * FROM means").collect()}
    want = {(3 - r.row, r.col): r.value for r in grid_observed(fixture(spark), g, "mean").collect() if r.value != -999.0}
    assert got == want
    assert grid_observations is not None


def test_masked_array_of_a_raster(spark):
    raster = spark.createDataFrame([(0, 10.0), (1, -999.0), (2, 1000.0), (3, 0.0), (4, None), (5, 1.0)], "idx long, value double")
    plain = to_masked_numpy(raster, 3, 2)
    assert plain.mask.tolist() == [[False, True, False], [False, True, False]] and plain.filled(-1).tolist() == [[10, -1, 1000], [0, -1, 1]]
    log = to_masked_numpy(raster, 3, 2, log=True)
    assert log.mask.tolist() == [[False, True, False], [True, True, False]] and log.filled(-1).tolist() == [[1, -1, 3], [-1, -1, 0]]


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_neighbours_over_empty_regions(spark, seed):
    """Two far clusters and targets all over, some on observations: by brute force."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(0, 10, (300, 2)), rng.normal(1e5, 3, (300, 2)), [[5e4, -7e4]]]).astype(f32)
    seen = [(k, float(x), float(y), 0.0, 1.0) for k, (x, y) in enumerate(xy)]
    places = np.concatenate([rng.uniform(-2e5, 3e5, (60, 2)), xy[::40].astype(float)])
    got = q.nearest_neighbour(spark.createDataFrame(seen, SCHEMA), spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "target_id long, x double, y double"), tile=40.0).collect()
    d2 = ((places[:, None] - xy[None].astype(float)) ** 2).sum(2)
    assert len(got) == len(places)
    for r in got:
        assert r.d2 == pytest.approx(d2[r.target_id].min()) and r.record_index == int(np.flatnonzero(d2[r.target_id] == r.d2)[0])
