"""Every query of the grid engine against its DuckDB counterpart."""

import duckdb
import pytest

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or a != a and b != b


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert name in catalogue.ORACLES
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(map(same, a, b)), (a, b)
