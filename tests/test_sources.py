import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.operators import query as q
from gridloom.plans.gridspec import Bounds
from gridloom.sources.index import check_index, load_index, save_index, with_values
from gridloom.sources.rawio import read_raster, read_raw, write_raster
from gridloom.sources.timemap import linear_timemap


def put(path, values, kind="float32"):
    np.array(values, kind).tofile(path)
    return str(path)


def test_raw_coordinates(spark, tmp_path):
    lats, lons = put(tmp_path / "lat", np.zeros(10)), put(tmp_path / "lon", np.zeros(10))
    rows = read_raw(spark, lats, lons, slice=3).collect()
    assert [tuple(r) for r in sorted(rows)] == [(k, 0.0, 0.0, 0.0) for k in range(10)]
    times = put(tmp_path / "t", np.arange(10))
    assert sorted(r.t for r in read_raw(spark, lats, lons, times).collect()) == list(range(10))


def test_raw_errors(spark, tmp_path):
    ten, nine = put(tmp_path / "ten", np.zeros(10)), put(tmp_path / "nine", np.zeros(9))
    odd = put(tmp_path / "odd", np.zeros(7), "uint8")
    for bad in ({"lats": ten, "lons": nine}, {"lats": ten, "lons": str(tmp_path / "none")}, {"lats": ten}, {}, {"data": odd}, {"lats": ten, "lons": ten, "data": odd, "dtype": "uint8"}):
        with pytest.raises(ValueError):
            read_raw(spark, **bad)


@pytest.mark.parametrize("kind", ["uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "float32", "float64"])
def test_raw_numeric_round_trip(spark, tmp_path, kind):
    values = np.array([0, 1, 100, 77], kind)
    if kind.startswith("uint"):
        values[3] = np.iinfo(kind).max
    path = put(tmp_path / "in", values, kind)
    raster = read_raster(spark, path, 2, kind)
    write_raster(raster, str(tmp_path / "out"), 4, kind)
    assert (np.fromfile(tmp_path / "out", kind) == values).all()


def test_raw_coded_round_trip(spark, tmp_path):
    raw = bytes(range(32))
    (tmp_path / "in").write_bytes(raw)
    write_raster(read_raster(spark, str(tmp_path / "in"), 4, "coded32"), str(tmp_path / "out"), 8, "coded32")
    assert (tmp_path / "out").read_bytes() == raw


def test_a_failed_write_leaves_the_old_raster(spark, tmp_path):
    path = tmp_path / "raster"
    put(path, [1, 2, 3, 4], "int32")
    before = path.read_bytes()
    bad = spark.range(4).selectExpr("id AS idx", "CAST(CASE WHEN id = 3 THEN raise_error('no') ELSE id END AS INT) AS value")
    with pytest.raises(Exception, match="no"):
        write_raster(bad, str(path), 4, "int32")
    assert path.read_bytes() == before and [f.name for f in tmp_path.iterdir()] == ["raster"]


def test_empty_raw_file(spark, tmp_path):
    assert read_raw(spark, data=put(tmp_path / "e", [])).count() == 0


def observations(spark):
    return q.observe(spark.createDataFrame([(k, float(k % 40), float(k % 25), float(k), 1.0 * k) for k in range(500)], "record_index long, lon float, lat float, t float, value double"))


def test_index(spark, tmp_path):
    path, o = str(tmp_path / "index"), observations(spark)
    save_index(o, path, "+proj=eqc +datum=WGS84")
    index = load_index(spark, path)
    assert index.num_observations == 500 and index.projection.definition == "+proj=eqc +datum=WGS84"
    assert sorted(map(tuple, index.observed.collect())) == sorted(map(tuple, o.select("record_index", "x", "y", "t").collect()))
    assert with_values(index, o).count() == 500
    assert index.tile == 250_000.0 and tuple(check_index(spark, path).first()) == (500, True, True, True)
    found = q.range_query(index.observed, Bounds(0, 1e6, 0, 1e6))
    assert "PushedFilters: [IsNotNull" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("line", ["", "nonsense", "{}", json.dumps({"format_version": 9, "projection": "+proj=eqc", "num_observations": 500}), json.dumps({"format_version": 1, "projection": "+proj=eqc", "num_observations": 3}), json.dumps({"format_version": 1, "projection": "bad", "num_observations": 500})])
def test_corrupt_index(spark, tmp_path, line):
    path = str(tmp_path / "index")
    save_index(observations(spark), path, "+proj=eqc")
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    with pytest.raises(ValueError):
        load_index(spark, path)


def test_broken_index_invariants(spark, tmp_path):
    path = str(tmp_path / "index")
    o = observations(spark)
    save_index(o, path, "+proj=eqc")
    twice = o.select("record_index", "x", "y", "t").where("record_index < 250")
    nan = twice.withColumn("x", F.lit(float("nan")).cast("float"))
    twice.union(nan).repartition(3, "record_index").write.mode("overwrite").parquet(f"{path}/observations")
    assert tuple(check_index(spark, path).first()) == (500, False, False, False)


def test_timemap(spark):
    got = {(r.row, r.col): r.t for r in linear_timemap(spark, 3, 5, 10.0, 20.0).collect()}
    assert got == {(r, c): float(np.float32(np.linspace(10, 20, 5)[r])) for r in range(5) for c in range(3)}
    assert {r.t for r in linear_timemap(spark, 2, 1, 4.0, 9.0).collect()} == {4.0}


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    lats, lons = put(tmp_path / "lat", rng.uniform(-80, 80, 2000)), put(tmp_path / "lon", rng.uniform(-180, 180, 2000))
    data = put(tmp_path / "data", rng.integers(0, 100, 2000), "int16")
    common = ["--width", "8", "--height", "4", "--input-data", data, "--input-dtype", "int16", "--reduction-function", "newest"]
    out = ["--output-data", str(tmp_path / "a"), "--output-lats", str(tmp_path / "la"), "--output-lons", str(tmp_path / "lo")]
    assert cli.main(["--input-lats", lats, "--input-lons", lons, "--save-index", str(tmp_path / "ix"), *common, *out]) == 0
    assert cli.main(["--load-index", str(tmp_path / "ix"), *common, "--output-data", str(tmp_path / "b")]) == 0
    a = np.fromfile(tmp_path / "a", "int16")
    assert len(a) == 32 and (a == np.fromfile(tmp_path / "b", "int16")).all() and (a >= 0).any()
    assert (np.diff(np.fromfile(tmp_path / "la", "float32").reshape(4, 8)[:, 0]) < 0).all()
    assert cli.main(["extent", "+proj=merc +ellps=WGS84 +lat_ts=55.0 +lon_0=-15.0", "63", "47", "13", "-15", "1100", "1100"]) == 0
    assert "Width: 1629" in capsys.readouterr().out


@pytest.mark.parametrize(
    "words",
    [
        [],
        ["--input-lats", "a", "--input-lons", "b"],
        ["--load-index", "a", "--save-index", "b"],
        ["--save-index", "x", "--input-lats", "a"],
        ["--load-index", "a", "--output-lats", "b"],
        ["--load-index", "a", "--input-data", "b", "--output-data", "c", "--output-dtype", "uint8"],
        ["--load-index", "a", "--input-data", "b", "--output-data", "c", "--width", "0"],
        ["--load-index", "a", "--input-data", "b", "--output-data", "c", "--reduction-function", "nope"],
    ],
)
def test_command_line_errors(words):
    with pytest.raises(SystemExit):
        cli.checked(words)
