"""Every query with a DuckDB statement against it, at the smallest size."""

import decimal
import math
import os

import duckdb
import pytest

from roadpulse.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "None" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    found = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


def test_every_query_has_a_statement():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
