from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from barterflow.llm import stripes


def by_hand(records, only=None):
    n, own, both = len(records), Counter(), Counter()
    for r in records:
        s = sorted({x for x in r or [] if x is not None and (only is None or x in only)})
        own.update(s)
        both.update(combinations(s, 2))
    return n, own, both


def g2(k, a, b, n):
    total = 0.0
    for o, e in ((k, a * b / n), (a - k, a * (n - b) / n), (b - k, (n - a) * b / n), (n - a - b + k, (n - a) * (n - b) / n)):
        total += o * math.log(o / e) if o else 0
    return 2 * total


@pytest.mark.parametrize("only", [None, ["a", "b", "c", "zz"]])
def test_against_brute_force(spark, only):
    rng = random.Random(3)
    records = [None, [], [None, "a"], ["a"] * 50, *[[rng.choice(["a", "b", "c", "d", "é", None, f"x{rng.randrange(40)}"]) for _ in range(rng.randrange(9))] for _ in range(300)], [f"x{i}" for i in range(400)]]
    df = spark.createDataFrame([(r, 1) for r in records], "items array<string>, n int")
    got = {(r.name_a, r.name_b): r for r in stripes.cooccurrence(df, "items", only).collect()}
    n, own, both = by_hand(records, only)
    assert {k: r.n_ab for k, r in got.items()} == dict(both)
    for (a, b), r in got.items():
        assert (r.n, r.n_a, r.n_b) == (n, own[a], own[b])
        assert r.llr == pytest.approx(max(0.0, g2(r.n_ab, r.n_a, r.n_b, n)), abs=1e-6)
        assert r.lift == pytest.approx(r.n_ab * n / (own[a] * own[b]))


def test_no_records(spark):
    df = spark.createDataFrame([], "items array<string>")
    assert stripes.cooccurrence(df, "items").count() == 0


def test_stripes_are_handed_on_when_full(spark, monkeypatch):
    monkeypatch.setattr(stripes, "HELD", 5)
    monkeypatch.setattr(stripes, "AT_ONCE", 7)
    records = [["a", "b", "c"], ["a", "b"], ["c", "d", "e", "f", "g"]] * 4
    held, total = stripes.Stripes(None), Counter()
    for r in records:
        held.add(pa.array([r], pa.list_(pa.string())))
        if held.full():
            total.update(unfolded(held.batch()))
    total.update(unfolded(held.batch()))
    _, own, both = by_hand(records)
    assert total[None, None] == 12
    assert {k: v for k, v in total.items() if k[0] is not None and k[0] < k[1]} == dict(both)
    assert {k[0]: v for k, v in total.items() if k[0] is not None and k[0] == k[1]} == dict(own)


def unfolded(batch):
    out = Counter()
    for item, _, neighbours, counts in zip(*[c.to_pylist() for c in batch.columns]):
        for x, n in zip(neighbours, counts):
            out[item, x] += n
    return out


def test_arrays_of_many_tasks_are_merged(spark, monkeypatch):
    """Partial stripes of one item come from every task, in sections, and more rows than a batch holds."""
    rng = random.Random(9)
    records = [["hot", *[f"x{rng.randrange(300)}" for _ in range(5)]] for _ in range(2000)]
    df = spark.createDataFrame([(r,) for r in records], "items array<string>").repartition(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        partial = stripes.partial_stripes(df, "items").persist()
        assert partial.where("item = 'hot'").select("section").distinct().count() > 50
        got = {(r.item, r.neighbour): r["count"] for r in stripes.merged_stripes(partial).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, own, both = by_hand(records)
    assert got[None, None] == n and {k: v for k, v in got.items() if k[0] is not None and k[0] < k[1]} == dict(both)


def test_a_larger_dictionary_gives_the_same_pairs(spark, monkeypatch):
    from barterflow.llm import queries

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, queries.p1_pairs(spark, d).collect()))
    monkeypatch.setattr(queries, "VOCABULARY", 10)
    assert sorted(map(tuple, queries.p1_pairs(spark, d).collect())) == want and len(want) > 10
