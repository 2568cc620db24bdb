"""Every query against its SQL, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from wayfare import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLES:
        o = duck.execute(catalog.ORACLES[name])
        at = {d[0]: k for k, d in enumerate(o.description)}
        assert sorted(at) == columns
        assert got == sorted(tuple(plain(r[at[c]]) for c in columns) for r in o.fetchall())
    else:
        assert got


def test_trailing_rate_of_odd_rows(spark, tmp_path):
    """Null users, times, ids and values, repeated times and rows: as the SQL has it."""
    con = duckdb.connect()
    con.execute(
        """CREATE TABLE events AS SELECT k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (k * 47) MINUTE AS ts, k % 3 AS user_id, (k % 7)::DOUBLE AS value FROM range(120) r(k)
        UNION ALL SELECT 200 + k, TIMESTAMP '2024-01-01' + INTERVAL (k * 47) MINUTE, NULL, 1.0 FROM range(20) r(k)
        UNION ALL SELECT 300 + k, NULL, k % 4, 5.0 FROM range(20) r(k)
        UNION ALL SELECT 400 + k, TIMESTAMP '2024-01-01' + INTERVAL (k * 90) MINUTE, 5, CASE WHEN k > 2 THEN k::DOUBLE END FROM range(20) r(k)
        UNION ALL SELECT CASE WHEN k % 2 = 0 THEN 500 + k END, TIMESTAMP '2024-01-01' + INTERVAL (k // 2 * 90) MINUTE, 6, k::DOUBLE FROM range(40) r(k)
        UNION ALL SELECT 600 + k // 2, TIMESTAMP '2024-01-01' + INTERVAL (k // 2 * 90) MINUTE, 7, 2.0 FROM range(40) r(k)"""
    )
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["trailing_rate"](spark, str(tmp_path)).select("user_id", "event_id", "rate").collect()]
    con.execute("SET threads = 1")
    assert sorted(got, key=repr) == sorted(con.execute(catalog.ORACLES["trailing_rate"]).fetchall(), key=repr)
