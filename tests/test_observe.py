import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import query as q
from gridloom.plans.gridspec import Bounds

BAD = [float("nan"), math.inf, -math.inf, None]


@pytest.mark.parametrize("column", ["lon", "lat", "t"])
@pytest.mark.parametrize("bad", BAD)
def test_what_is_not_finite(spark, column, bad):
    row = {"record_index": 1, "lon": 10.0, "lat": 20.0, "t": 3.0} | {column: bad}
    rows = spark.createDataFrame([tuple(row.values()), (2, 1.0, 2.0, 3.0)], "record_index long, lon float, lat float, t float")
    for kind in ("+proj=eqc +datum=WGS84", "+proj=sinu +datum=WGS84"):
        for shown in (["x"], ["x", "y", "t"]) if "eqc" in kind else (["x"], ["y"], ["x", "y", "t"]):
            with pytest.raises(Exception, match="isn't finite"):
                q.observe(rows, kind).select(*shown).collect()
        assert [r.record_index for r in q.observe(rows, kind, "drop").collect()] == [2]


def test_filters_copy_a_short_projection(spark):
    """A box copies x and y into each of its conditions, so the check for finite numbers stands once in either."""
    rows = spark.range(10).select(F.col("id").alias("record_index"), F.col("id").cast("float").alias("lon"), F.col("id").cast("float").alias("lat"), F.col("id").cast("float").alias("t"))
    plan = q.range_query(q.observe(rows), Bounds(-5e6, 5e6, -2e6, 6e6))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raise_error") <= 8
