from __future__ import annotations

import random

import pytest

from barterflow.operators.pigeonhole import within_edits


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [[(3, 1), (5, 2), (None, 3)], [(1, 0), (None, 1)], [(None, 6)], [(None, 0)]])
def test_same_as_all_pairs(spark, edits):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("カキク😀") for _ in range(rng.randint(1, 9)))
    values, refs = {word() for _ in range(60)}, {word() for _ in range(40)}
    got = {(r.value, r.ref, r.distance) for r in within_edits(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(r,) for r in refs], "ref string"), edits).collect()}
    allowed = lambda r: next(k for most, k in edits if most is None or len(r) <= most)
    assert got == {(v, r, distance(v, r)) for v in values for r in refs if distance(v, r) <= allowed(r)}


def test_null_and_empty_meet_nothing(spark):
    values = spark.createDataFrame([(None,), ("",), ("a",)], "value string")
    assert within_edits(values, spark.createDataFrame([(None,), ("",), ("b",)], "ref string"), [(None, 1)]).collect() == [("a", "b", 1)]
    assert within_edits(values, spark.createDataFrame([], "ref string"), [(None, 1)]).collect() == []
