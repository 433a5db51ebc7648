"""Every query on tables without a row: those that count give one row, or a row a window; the others none."""

from __future__ import annotations

import glob
import os

import pytest

from barterflow.plans import evidence, posts, signals

DATA = "/root/testdata/sf0.001"
QUERIES = {**signals.QUERIES, **evidence.QUERIES, **posts.QUERIES}
ROWS = {"chart_scale": 1, "coverage": 1, "backfill_summary": 1, "window_totals": 3, "image_counts": 1, "cell_counts": 1, "audit_report": 1, "translated_audit": 2}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(path).where("false").write.parquet(f"{folder}/{os.path.basename(path)}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == ROWS.get(name, 0)
