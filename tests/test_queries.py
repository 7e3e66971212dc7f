"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from offerlake.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(duck.sql(f"SELECT {listed} FROM want").fetchall())
