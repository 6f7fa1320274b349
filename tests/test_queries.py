"""Every query of the library against its own SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from framesift.plans import registry

SF = Path("/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def canonical(value):
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{float(value):.6g}" if isinstance(value, (int, float)) or hasattr(value, "as_tuple") else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    columns = sorted(got.columns)
    rows = sorted(tuple(canonical(v) for v in r) for r in got.select(columns).collect())
    if name not in SQL:
        # tests/test_plain_versions.py and tests/test_learner.py hold these against plain versions
        assert columns and rows
        return
    want = duck.execute(SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert rows == sorted(tuple(canonical(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
