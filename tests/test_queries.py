import duckdb
import pytest

from perigee.plans.queries import FRAMES, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    want = want.fetchall()
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got


@pytest.mark.parametrize("name", sorted(FRAMES))
def test_frame_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
