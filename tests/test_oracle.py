"""Every registered event query against its DuckDB SQL on the smallest tables, or on those that ISOPLETH_SF_DIR names."""

import os

import duckdb
import pytest

from isopleth.plans import oracle, queries

SF = os.environ.get("ISOPLETH_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    session = duckdb.connect()
    session.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        session.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return session


def tidy(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, db, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(oracle.oracle_sql()[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert tidy(got.select(columns).collect()) == tidy(want.select(quoted).fetchall())
