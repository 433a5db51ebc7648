"""Every query on tables without a row."""

from __future__ import annotations

import glob
import os

import pytest

from barterflow.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(path).where("false").write.parquet(f"{folder}/{os.path.basename(path)}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows_in_no_rows_out(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0
