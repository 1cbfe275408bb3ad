"""Every query with oracle SQL against DuckDB, over the smallest tables."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb
import pytest

from waterlens.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    found = catalog.queries()[name](spark, FOLDER)
    names = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    got = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in got.fetchall()), key=repr)
