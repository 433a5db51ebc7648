from __future__ import annotations

import random
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from barterflow.llm import packing


@lru_cache(None)
def fewest(sizes: tuple[int, ...], capacity: int) -> int:
    """The least number of containers, by trying."""
    best = len(sizes)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:k]:
                rooms[k] -= sizes[i]
                place(i + 1, rooms)
                rooms[k] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_fewest_containers_on_small_cases(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 12, 30, 100])
    sizes = sorted((rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 9))), reverse=True)
    got = packing.complete(list(sizes), capacity)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in got)
    assert len(got) == fewest(tuple(sizes), capacity)


def test_better_than_best_fit():
    rng = random.Random(5)
    better = 0
    for _ in range(150):
        sizes = [rng.choice([6, 5, 4, 3, 2, 7]) for _ in range(rng.randint(12, 30))]
        a, b = len(packing.best_fit(sizes, 15)), len(packing.complete(sizes, 15))
        assert b <= a
        better += b < a
    assert better


def test_domination():
    assert packing.dominates((10,), (4, 5)) and packing.dominates((5, 3), (5, 2)) and not packing.dominates((5, 3), (4, 4)) and not packing.dominates((3, 3), (2, 2, 2))
    assert packing.dominates((9, 4), (5, 4, 4)) and packing.dominates((7, 6), (4, 3, 3, 3)) and not packing.dominates((6, 6), (4, 4, 4)) and packing.dominates((3,), ())
    assert not packing.dominates((100,), (1,) * 11)  # not weighed


@pytest.mark.parametrize("seed", range(20))
def test_what_is_proven_is_so(seed):
    rng = random.Random(seed)
    for nodes in (1, 5, 50, None):
        capacity = rng.choice([20, 30, 50])
        sizes = sorted((rng.randint(2, capacity * 2 // 3) for _ in range(rng.randint(6, 10))), reverse=True)
        got, proven = packing.completed(list(sizes), capacity, nodes)
        assert sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in got)
        assert proven or nodes is not None
        if proven:
            assert len(got) == fewest(tuple(sizes), capacity)


def test_an_audit_finds_what_is_wrong(spark):
    kinds = spark.createDataFrame([(1, "t", 10)], KINDS)
    sizes = spark.createDataFrame([(1, 4), (2, 15), (3, 0), (4, None)], SIZES)
    good = packing.packed(sizes, kinds)
    assert [tuple(r) for r in packing.audited(good, sizes, kinds).collect()] == [(1, 4, 0, 0)]
    lost, twice = good.where("NOT (doc_id = 2 AND piece = 1)"), good.unionByName(good.where("doc_id = 1"))
    assert packing.audited(lost, sizes, kinds).first().broken == 1
    bad = packing.audited(twice, sizes, kinds).first()
    assert bad.broken == 1 and bad.overfull == 1


SIZES, KINDS = "doc_id bigint, tokens bigint", "container_id int, tokenizer string, capacity int"


def test_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    rng = random.Random(1)
    docs = {i: rng.choice([0, 1, 7, 31, 32, 33, 64, 100, rng.randint(1, 90)]) for i in range(400)} | {400: None}
    sizes = spark.createDataFrame(list(docs.items()), SIZES)
    kinds = spark.createDataFrame([(1, "t", 32), (2, "t", 100), (3, "t", 0), (None, "t", 5)], KINDS)
    rows = packing.packed(sizes, kinds).collect()
    for kind, capacity in ((1, 32), (2, 100)):
        mine = [r for r in rows if r.container_id == kind]
        parts, bins = defaultdict(list), defaultdict(int)
        for r in mine:
            parts[r.doc_id].append((r.piece, r.begin_token, r.tokens))
            if r.bin_id is not None:
                bins[r.bin_id] += r.tokens
        for d, n in docs.items():
            got = sorted(parts[d])
            assert [p for p, _, _ in got] == list(range(len(got))) and sum(t for _, _, t in got) == (n or 0)
            assert len(got) == max(1, -(-(n or 0) // capacity)) and all(b == p * capacity for p, b, _ in got)
        assert all(0 < n <= capacity for n in bins.values())
        assert {r.room for r in mine if r.bin_id} == {capacity - n for n in bins.values()}
        assert all(capacity - bins[r.bin_id] == r.room for r in mine if r.bin_id)
        assert all((r.bin_id is None) == (r.tokens == 0) for r in mine)
    assert {r.container_id for r in rows} == {1, 2}
    w = {r.container_id: r for r in packing.waste(packing.packed(sizes, kinds), kinds).collect()}
    assert w[2].filled > 0.9 and w[2].bins >= w[2].least_bins


def test_empty(spark):
    kinds = spark.createDataFrame([(1, "t", 32)], KINDS)
    assert packing.packed(spark.createDataFrame([], SIZES), kinds).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_fewest_containers_whichever_filling_is_tried_first(monkeypatch, seed):
    """Fillings beyond the ones tried first aren't given up."""
    monkeypatch.setattr(packing, "FILLINGS", 1)
    monkeypatch.setattr(packing, "TRIES", 1)
    rng = random.Random(seed)
    for _ in range(20):
        capacity = rng.choice([20, 30, 50])
        sizes = sorted((rng.randint(2, capacity * 2 // 3) for _ in range(rng.randint(6, 10))), reverse=True)
        got = packing.complete(list(sizes), capacity)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in got)
        assert len(got) == fewest(tuple(sizes), capacity)


def test_every_filling_is_found():
    from itertools import combinations

    for seed in range(40):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(1, 9) for _ in range(8)), reverse=True)
        rest, room = sizes[1:], 20 - sizes[0]
        fits = {c for n in range(8) for c in combinations(rest, n) if sum(c) <= room}
        want = {c for c in fits if not any(len(d) == len(c) + 1 and not (Counter(c) - Counter(d)) for d in fits)}
        got = [f for f in packing.every_filling(packing.Stock(sizes), sizes[0], 20) if f is not None]
        assert len(got) == len(set(got)) and {f[1:] for f in got} == want
