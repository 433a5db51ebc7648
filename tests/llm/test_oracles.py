"""Every query of the subpackage with an SQL counterpart gives the same rows, on the smallest tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import pytest

from barterflow.llm import queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, order):
    value = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    found = sql.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.select(*sorted(columns)).collect(), range(len(columns))) == plain(found.fetchall(), [columns.index(c) for c in sorted(columns)])
