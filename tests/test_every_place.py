"""The projections against their SQL, bit by bit, at all 36,000 places that events can have."""

import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.plans import catalogue

PLACES = 36_000
#: laea at the south pole: y is -8828174.511, which is -8828175 in 32 bits; the SQL's arcsine of nearly -1 is a decimetre off.
BUT = {"project_laea_forward": {18_000}}


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("places"))
    spark.range(PLACES).select(F.col("id").alias("event_id"), F.col("id").cast("double").alias("value")).coalesce(1).write.parquet(f"{path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return path, duck


def bits(row):
    return tuple(struct.pack("<d", v) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n.startswith("project_") or n.startswith("grid_geolocation")))
def test_bits(spark, places, name):
    path, duck = places
    df = catalogue.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    got = {bits(r) for r in df.select(columns).collect()}
    want = {bits(r) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()}
    at, but = [c in ("record_index", "idx") for c in columns].index(True), BUT.get(name, set())
    differ = sorted(r for r in got ^ want if r[at] not in but)
    assert differ == []
