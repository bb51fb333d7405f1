import numpy as np

from gridloom.sources.rawio import SLICE, TASKS, _Reader, read_raw


def test_small_slices_share_tasks(spark, tmp_path):
    n = 100_003
    for name, values in (("lat", np.arange(n) % 90), ("lon", np.arange(n) % 180)):
        values.astype("float32").tofile(tmp_path / name)
    lats, lons = str(tmp_path / "lat"), str(tmp_path / "lon")
    assert read_raw(spark, lats, lons, slice=7).rdd.getNumPartitions() <= TASKS  # 14,287 before
    rows = read_raw(spark, lats, lons, slice=7).orderBy("record_index").toPandas()
    assert (rows["record_index"].to_numpy() == np.arange(n)).all()
    assert (rows["lat"].to_numpy() == np.arange(n) % 90).all() and (rows["lon"].to_numpy() == np.arange(n) % 180).all()


def test_tasks_hold_every_slice_once():
    reader = object.__new__(_Reader)
    for n in (0, 1, 699, 700, 701, 44_800, 44_801, 10**6, 36 * 10**6, 10**10):
        for size in (1, 700, SLICE, 2 * SLICE):
            reader.n, reader.slice = n, size
            parts = reader.partitions()
            at = 0
            for p in parts:
                assert p.start == at and at % size == 0 and (p.count > 0 or not n)
                at += p.count
            assert at == n and len(parts) <= max(TASKS, -(-n // SLICE), 1)
