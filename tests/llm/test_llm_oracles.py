"""The training-data queries that SQL can express against DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from waterlens.llm import queries

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = queries.QUERIES[name](spark, FOLDER)
    names = sorted(found.columns)
    got = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    rows = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in got.fetchall()), key=repr)
