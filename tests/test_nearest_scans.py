import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import query as q


def test_rounds_read_no_observations(spark, monkeypatch):
    """However many rounds, observations are projected once; copies of few places make no difference."""
    plans, write = {}, q.written
    monkeypatch.setattr(q, "written", lambda df, label: plans.setdefault(label, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label))
    n, places = 20_000, 60
    at = F.col("id") % places
    rows = spark.range(n).select(F.col("id").alias("record_index"), ((at * 7 % places).cast("float") * 3 - 90).alias("lon"), ((at * 11 % places).cast("float") - 30).alias("lat"))
    observed = q.observe(rows)
    targets = spark.createDataFrame([(k, 1e5 * (k % 20 - 10), 2e5 * (k // 20 - 3)) for k in range(120)], "target_id long, x float, y float")
    got = {r.target_id: (r.record_index, r.d2) for r in q.nearest_neighbour(observed, targets).collect()}
    assert len(plans["met"]) > 1  # rounds
    assert [label for label, all_of in plans.items() for p in all_of if "RADIANS" in p] == ["places"]  # tiles and every round before
    seen = observed.where(f"record_index < {places}").orderBy("record_index").select("x", "y").toPandas().to_numpy(float)
    for r in targets.collect():
        d2 = (r.x - seen[:, 0]) ** 2 + (r.y - seen[:, 1]) ** 2
        assert got[r.target_id] == (int(np.argmin(d2)), d2.min())
