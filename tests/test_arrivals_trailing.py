from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barterflow.operators.arrivals import BITMAPS, DICTIONARY, SeenState, bit_is_set, surplus_copies
from barterflow.operators.trailing import dense_daily, trailing_totals

ROWS = "row bigint, id string, at int, id2 string"


def by_hand(rows):
    best = {}
    for row, ident, at, _ in rows:
        if ident is None or not ident.strip():
            continue
        k = int(ident)
        v = (at is None, at or 0, row)
        best[k] = min(best.get(k, v), v)
    kept = {v[2] for v in best.values()}
    return {r for r, i, _, _ in rows if i is not None and i.strip() and r not in kept}


def test_surplus_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", " ", "7", *[str(rng.randrange(60)) for _ in range(6)], f" {rng.randrange(60)}", f"0{rng.randrange(60)}"]), rng.choice([None, *range(9)]), None) for i in range(800)]
    df = spark.createDataFrame(rows, ROWS)
    assert {r.row for r in surplus_copies(df, "id", ["at"], "row").collect()} == by_hand(rows)
    assert surplus_copies(df.where("false"), "id", ["at"], "row").count() == 0


def test_batches_share_what_was_seen(spark, tmp_path):
    state = SeenState(spark, f"file://{tmp_path}/s", 3)
    a = spark.createDataFrame([(1, "10", 1, None), (2, "10", 0, None), (3, "11", 1, None), (4, None, 1, None)], ROWS)
    b = spark.createDataFrame([(5, "0011", 0, None), (6, "12", 1, None), (7, "12", 1, None)], ROWS)
    assert sorted(r.row for r in state.ingest(a, "id", ["at"], "row").collect()) == [2, 3]
    assert sorted(r.row for r in state.ingest(b, "id", ["at"], "row").collect()) == [6]
    assert sorted(r.row for r in surplus_copies(a, "id", ["at"], "row", state).collect()) == [1, 2, 3]
    assert state.version() == 3 and SeenState(spark, state.path, 99).shards == 3
    assert state.bitmaps(3).agg(F.sum(F.bitmap_count("bits")).alias("n")).first().n == 3


def test_a_version_writes_what_is_new(spark, tmp_path):
    state = SeenState(spark, f"file://{tmp_path}/s", 2)
    rows = lambda ids: spark.createDataFrame([(i, str(i), 1, None) for i in ids], ROWS)
    state.ingest(rows(range(50)), "id", ["at"], "row")
    state.ingest(rows(range(45, 55)), "id", ["at"], "row")
    state.ingest(rows(range(10)), "id", ["at"], "row")
    assert [state.table(DICTIONARY, v).count() for v in (1, 2, 3)] == [50, 5, 0] and state.table(BITMAPS, 3).count() == 0
    assert state.dictionary(3).select("key").distinct().count() == state.dictionary(3).count() == 55
    assert state.dictionary(3).select("shard", "code").distinct().count() == 55


def test_bits_alone_decide(spark, tmp_path):
    """An identifier that has a code but whose bit isn't set is selected."""
    state = SeenState(spark, f"file://{tmp_path}/s", 2)
    a = spark.createDataFrame([(i, str(i), 1, None) for i in range(6)], ROWS)
    state.ingest(a, "id", ["at"], "row")
    none = spark.createDataFrame([], "shard int, bucket bigint, bits binary")
    folder = state._at(1)
    none.write.mode("overwrite").parquet(f"{folder}/{BITMAPS}")
    assert sorted(r.row for r in state.ingest(a, "id", ["at"], "row").collect()) == list(range(6))
    assert state.ingest(a, "id", ["at"], "row").count() == 0 and state.dictionary(3).count() == 6


def test_resharded(spark, tmp_path):
    state = SeenState(spark, f"file://{tmp_path}/s", 2)
    rows = lambda ids: spark.createDataFrame([(i, str(i), 1, None) for i in ids], ROWS)
    first = state.add(rows(range(40)), "id", ["at"], "row")
    state.ingest(rows(range(30, 60)), "id", ["at"], "row")
    assert state.reshard(5) == 3 and SeenState(spark, state.path).shards == 5
    assert state.dictionary(3).count() == 60 and {r.shard for r in state.dictionary(3).select("shard").distinct().collect()} <= set(range(5))
    assert sorted(r.row for r in state.ingest(rows(range(55, 65)), "id", ["at"], "row").collect()) == list(range(60, 65))
    assert state.selected(first, "row").count() == 40
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        state.table(DICTIONARY, 1).count()
    assert SeenState(spark, f"file://{tmp_path}/none").reshard(3) == 0


def test_a_version_is_committed_once(spark, tmp_path):
    state = SeenState(spark, f"file://{tmp_path}/s", 3)
    state._commit(1)
    with pytest.raises(RuntimeError):
        state._commit(1)


def test_bit_is_set(spark):
    bits = spark.createDataFrame([(5,), (8,), (32767,), (0,)], "p bigint").agg(F.bitmap_construct_agg("p").alias("b"))
    got = bits.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), bit_is_set(F.col("b"), F.lit(p)).alias("x")) for p in (0, 1, 5, 7, 8, 9, 32766, 32767)])).alias("s")).select("s.*").collect()
    assert {r.p for r in got if r.x} == {0, 5, 8, 32767}


@pytest.mark.parametrize("days", [1, 6, 7, 29, 30, 31, 75])
def test_trailing_against_brute_force(spark, days):
    rng = random.Random(days)
    first = date(2026, 1, 30)
    daily = {(n, first + timedelta(d)): rng.randrange(5) for n in "ab" for d in range(days) if rng.random() < 0.6}
    df = spark.createDataFrame([(n, d, t) for (n, d), t in daily.items()] or [("a", first, 0)], "name string, day date, total bigint")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    dense = dense_daily(df, names, first, first + timedelta(days - 1))
    got = trailing_totals(dense, (7, 30)).collect()
    assert len(got) == 3 * days
    for r in got:
        for p in (7, 30):
            want = sum(daily.get((r.name, r.day - timedelta(k)), 0) for k in range(p))
            assert r[f"t{p}"] == want and r[f"a{p}"] == pytest.approx(want / p)


def test_posts_queries_on_empty_and_dirty_tables(spark, tmp_path):
    from barterflow.plans import posts

    schema = "hit_id bigint, id string, author string, created_at timestamp, query string, demand array<string>, supply array<string>, run_id bigint, collected_at timestamp, name string, day int"
    cards = spark.createDataFrame([(["a", "b", None, "a"], [])], "cards array<string>, aliases array<struct<alias:string,canonical:string>>")
    for what, rows in (("none", []), ("undated", [(1, "5", None, None, None, ["a"], None, 1, None, "x", 1), (2, "5", None, None, None, None, [None], 1, None, "x", 1)])):
        d = f"{tmp_path}/{what}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/posts.parquet")
        cards.write.parquet(f"{d}/cards.parquet")
        assert posts.p4_totals(spark, d).count() == 0 and posts.p4_found(spark, d).count() == 0
        assert [r.hit_id for r in posts.p3_found(spark, d).collect()] == ([2] if rows else [])


def test_p3_found_selects_by_the_bits_of_earlier_batches(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from barterflow.plans import posts

    rng = random.Random(3)
    rows = [(i, rng.choice([None, " ", *[str(rng.randrange(40)) for _ in range(8)], f"0{rng.randrange(40)}"]), rng.choice([None, *range(12)]), None) for i in range(400)]
    at = lambda m: m if m is None else datetime(2026, 1, 1, 0, m)
    spark.createDataFrame([(i, k, at(m)) for i, k, m, _ in rows], "hit_id bigint, id string, collected_at timestamp").write.parquet(f"{tmp_path}/posts.parquet")
    states = []
    init = SeenState.__init__
    monkeypatch.setattr(SeenState, "__init__", lambda self, *a: (states.append(self), init(self, *a))[1])
    assert {r.hit_id for r in posts.p3_found(spark, str(tmp_path)).collect()} == by_hand(rows)
    assert states[0].version() == posts.BATCHES
