"""Texts put into containers of fixed capacity with little room left over (problem 7).

A text larger than a container is cut into full containers and a rest; nothing else is
split. The pieces are dealt into blocks of bounded size by a hash of their document, and each
block is filled by bin completion: the largest piece left opens a container, the undominated
fillings of the room beside it are enumerated, a branch is cut where the room wasted so far
exceeds what a better packing than the best one known could waste, and best-fit decreasing
gives the first one known. The most promising fillings are tried first, all others on the way
back, until the search has opened as many containers as it may. The last containers of all blocks, which alone can be poorly
filled, are then dealt into larger blocks and filled again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barterflow.shared import materialised

#: Pieces of a block, fillings of a container tried before all others, sizes tried while looking for them, and containers opened (or fillings passed over) before a block keeps the best packing it has.
BLOCK, FILLINGS, TRIES, NODES = 4096, 4, 96, 6000
#: Pieces of a filling up to which it is weighed whether another one dominates it.
MOST_WEIGHED = 10
#: Kinds of containers; more are refused.
MOST_KINDS = 1000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of each container by best-fit decreasing."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[tuple[int, int]] = []  # room left and container, ascending
    bins: list[list[int]] = []
    for i in order:
        k = bisect_left(room, (sizes[i], -1))
        if k == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


class Stock:
    """Pieces left, by size."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.order = sorted(self.count)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]
            self.order.pop(bisect_left(self.order, s))

    def put(self, s: int) -> None:
        if s in self.count:
            self.count[s] += 1
        else:
            self.count[s] = 1
            insort(self.order, s)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` can be parted into groups of which each fits into another piece of ``a``: ``b`` then never packs better than ``a``.

    Found by trying where each piece goes, the largest first. Fillings of more than MOST_WEIGHED pieces are not weighed
    (False): they are tried, which costs time and loses nothing.
    """
    if sum(b) > sum(a) or len(b) > MOST_WEIGHED:
        return False
    pieces, room = sorted(b, reverse=True), sorted(a, reverse=True)

    def place(i: int) -> bool:
        if i == len(pieces):
            return True
        for k, left in enumerate(room):
            if left >= pieces[i] and left not in room[:k]:
                room[k] -= pieces[i]
                if place(i + 1):
                    return True
                room[k] += pieces[i]
        return False

    return place(0)


def fillings(stock: Stock, room: int) -> list[tuple[int, ...]]:
    """Undominated maximal fillings of ``room``, the least waste first: depth first from the largest size that fits, until one wastes nothing or TRIES sizes were tried."""
    found: list[tuple[int, tuple[int, ...]]] = []
    chosen: list[int] = []
    tries = 0

    def down(left: int, top: int) -> bool:
        """True: stop looking. ``top``: sizes up to here may still be chosen."""
        nonlocal tries
        k = bisect_right(stock.order, min(left, top)) - 1
        if k < 0 or not left:
            filling = tuple(chosen)
            if not any(dominates(f, filling) for _, f in found):
                found[:] = [(w, f) for w, f in found if not dominates(filling, f)]
                insort(found, (left, filling))
                del found[FILLINGS:]
            return not left or tries >= TRIES
        branches = 0
        while k >= 0 and branches < 3:
            s = stock.order[k]
            tries += 1
            stock.take(s)
            chosen.append(s)
            stop = down(left - s, s)
            chosen.pop()
            stock.put(s)
            if stop:
                return True
            k = bisect_left(stock.order, s) - 1
            branches += 1
        return tries >= TRIES

    # long chains of small pieces are taken one by one, only the last choices are weighed
    greedy: list[int] = []
    left = room
    while stock.order and left > 4 * stock.order[-1]:
        s = stock.order[-1]
        greedy.append(s)
        stock.take(s)
        left -= s
    down(left, left)
    for s in greedy:
        stock.put(s)
    return [tuple(greedy) + f for _, f in found]


def every_filling(stock: Stock, first: int, capacity: int) -> Iterator[tuple[int, ...] | None]:
    """All maximal fillings of a container that ``first`` opens, larger pieces first; None in place of one that isn't maximal. Reads the stock once, when the first is asked for."""
    left = capacity - first
    order = [s for s in reversed(stock.order) if s <= left]
    count = [stock.count[s] - (s == first) for s in order]
    chosen: list[int] = []
    k = 0
    while True:
        while k < len(order):  # down: each size as often as it fits
            if count[k] and order[k] <= left:
                count[k] -= 1
                left -= order[k]
                chosen.append(k)
            else:
                k += 1
        smallest = next((order[i] for i in range(len(order) - 1, -1, -1) if count[i]), capacity + 1)
        yield None if smallest <= left else (first, *(order[i] for i in chosen))
        if not chosen:
            return
        k = chosen.pop()  # back: without the last one and its like
        count[k] += 1
        left += order[k]
        k += 1


def others(tried: list[tuple[int, ...]], found: Iterator[tuple[int, ...] | None]) -> Iterator[tuple[int, ...] | None]:
    """``found``, with None in place of what one of ``tried`` dominates."""
    for f in found:
        yield None if f is None or any(dominates(t[1:], f[1:]) for t in tried) else f


def complete(sizes: list[int], capacity: int) -> list[list[int]]:
    """As ``completed`` under NODES; the packing alone."""
    return completed(sizes, capacity, NODES)[0]


def completed(sizes: list[int], capacity: int, nodes_at_most: int | None = NODES) -> tuple[list[list[int]], bool]:
    """Indices of the pieces of each container, every piece in exactly one, and whether it is proven that no packing needs fewer.

    Proven is what meets the bound by the sizes' sum, and what a search that came to its end has left. ``nodes_at_most``:
    containers opened before a better packing found ends the search; twice as many end it in any case. None: the search
    goes on to its end, which is exact and may take very long.
    """
    known = best_fit(sizes, capacity)
    total = sum(sizes)
    least = -(-total // capacity)
    if len(known) == least:
        return known, True
    most = float("inf") if nodes_at_most is None else nodes_at_most
    stock = Stock(sizes)
    path: list[tuple[tuple[int, ...], Iterator[tuple[int, ...] | None]]] = []  # filling in force, fillings still to try
    waste, nodes, best = 0, 0, None
    going = True
    while going:
        limit = (len(known) if best is None else len(best)) - 1
        allowed = limit * capacity - total
        if not stock.order:
            best = [f for f, _ in path]
            if len(best) == least or nodes >= most:
                break
            options: Iterator[tuple[int, ...] | None] = iter(())
        elif waste > allowed:
            options = iter(())
        else:
            nodes += 1
            first = stock.order[-1]
            stock.take(first)
            likely = [(first, *f) for f in fillings(stock, capacity - first)]
            stock.put(first)
            options = iter(likely[:1]) if nodes >= most * 2 else chain(likely, others(likely, every_filling(stock, first, capacity)))
        while True:
            now = None
            for now in options:
                if now is not None and waste + capacity - sum(now) <= allowed:
                    break
                now = None
                nodes += 1
                if nodes >= most * 2:
                    break
            if now is not None:
                for s in now:
                    stock.take(s)
                waste += capacity - sum(now)
                path.append((now, options))
                break
            if not path or nodes >= most * 2:
                going = False
                break
            undone, options = path.pop()
            for s in undone:
                stock.put(s)
            waste -= capacity - sum(undone)
    proven = not nodes >= most * 2 if best is None else len(best) == least or (not path and nodes < most * 2)
    if best is None or len(best) >= len(known):
        return known, proven
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    return [[by_size[s].pop() for s in f] for f in best], proven


PACKED = "container_id int, capacity int, block bigint, bin int, doc_id bigint, piece int, begin_token bigint, tokens bigint, room bigint, proven boolean"


def _fill(pieces: DataFrame) -> DataFrame:
    """Adds bin (in its block) and room (left in that container) to container_id, capacity, block, doc_id, piece, begin_token, tokens."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes, capacity = table["tokens"].to_pylist(), table["capacity"][0].as_py()
        bins, room = [0] * len(sizes), [0] * len(sizes)
        packing, proven = completed(sizes, capacity)
        for b, members in enumerate(packing):
            left = capacity - sum(sizes[i] for i in members)
            for i in members:
                bins[i], room[i] = b, left
        return pa.table({"container_id": table["container_id"], "capacity": table["capacity"], "block": table["block"], "bin": pa.array(bins, pa.int32()), "doc_id": table["doc_id"], "piece": table["piece"], "begin_token": table["begin_token"], "tokens": table["tokens"], "room": pa.array(room, pa.int64()), "proven": pa.array([proven] * len(sizes), pa.bool_())})

    return pieces.groupBy("container_id", "block").applyInArrow(run, PACKED)


def _dealt(pieces: DataFrame, counts: dict[int, int], salt: int) -> DataFrame:
    """Column block: as many blocks of each container kind as BLOCK pieces a block need, by a hash of the document and piece."""
    blocks = F.lit(1).cast("bigint")
    for kind, n in counts.items():
        blocks = F.when(F.col("container_id") == kind, F.lit(max(1, -(-n // BLOCK)))).otherwise(blocks)
    return pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), blocks))


def _counts(pieces: DataFrame) -> dict[int, int]:
    """Pieces of each container kind; the kinds are a small fixed table."""
    return {r.container_id: r.n for r in pieces.groupBy("container_id").agg(F.count("*").alias("n")).collect()}


def packed(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """container_id, bin_id, doc_id, piece, begin_token, tokens, room, proven of every piece of every document in every kind of container.

    ``sizes``: doc_id, tokens; ``containers``: container_id, capacity (rows without a positive
    capacity are left out). A document within the capacity is one piece 0; a larger one is cut
    into full containers and a rest. A document of 0 tokens takes no room: bin_id and room null.
    ``room`` is what is left in the piece's container; ``proven``: no packing of the container's block needs fewer.
    Documents of unknown size (null) count as 0.
    """
    kinds = containers.where("capacity > 0 AND container_id IS NOT NULL").select(F.col("container_id").cast("int").alias("container_id"), F.col("capacity").cast("int").alias("capacity")).distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    every = F.array(*[F.struct(F.lit(k.container_id).alias("container_id"), F.lit(k.capacity).alias("capacity")) for k in kinds]).cast("array<struct<container_id:int,capacity:int>>")
    each = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("size"), F.explode(every).alias("kind")).select("doc_id", "size", "kind.*")
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1))))
    begin = F.col("piece").cast("bigint") * F.col("capacity")
    pieces = pieces.select("container_id", "capacity", "doc_id", "piece", begin.alias("begin_token"), F.least(F.col("capacity").cast("bigint"), F.col("size") - begin).alias("tokens"))
    done = pieces.where("tokens = 0 OR tokens = capacity").select("container_id", F.when(F.col("tokens") > 0, F.format_string("full-%d-%d", "doc_id", "piece")).alias("bin_id"), "doc_id", "piece", "begin_token", "tokens", F.when(F.col("tokens") > 0, F.lit(0).cast("bigint")).alias("room"), F.when(F.col("tokens") > 0, F.lit(True)).alias("proven"))
    loose = pieces.where("tokens > 0 AND tokens < capacity")
    first = materialised(_fill(_dealt(loose, _counts(loose), 0)), "packed")
    poor = first.where("room * 50 > capacity").drop("block", "bin", "room", "proven")
    again = _fill(_dealt(poor, _counts(poor), 1))

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("container_id", F.format_string(name + "-%d-%d", "block", "bin").alias("bin_id"), "doc_id", "piece", "begin_token", "tokens", "room", "proven")

    return done.unionByName(named(first.where("room * 50 <= capacity"), "a")).unionByName(named(again, "b"))


def waste(fillings_of: DataFrame, containers: DataFrame) -> DataFrame:
    """container_id, bins, tokens, least_bins (no packing needs fewer), filled (share of the room used), proven (share of containers in blocks no packing of which needs fewer)."""
    used = fillings_of.where("bin_id IS NOT NULL")
    bins = used.groupBy("container_id", "bin_id").agg(F.sum("tokens").alias("tokens"), F.bool_and("proven").alias("proven")).groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.count_if("proven").alias("sure"))
    return bins.join(containers.select("container_id", "capacity"), "container_id").select("container_id", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"), F.round(F.col("sure") / F.col("bins"), 4).alias("proven"))


def audited(fillings_of: DataFrame, sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """container_id, documents, broken (documents whose pieces aren't their tokens, each once and in order, cut only beyond the capacity), overfull (containers that hold more than they can, or whose room is told wrong)."""
    kinds = containers.select("container_id", "capacity")
    pieces = fillings_of.groupBy("container_id", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("begin_token").alias("begins"), F.sum("tokens").alias("total"), F.max(F.col("begin_token") + F.col("tokens")).alias("end"), F.max("tokens").alias("largest"))
    whole = pieces.join(sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("size")), "doc_id", "left").join(kinds, "container_id")
    fine = (F.col("total") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("begins") == F.col("n")) & (F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))))
    documents = whole.groupBy("container_id").agg(F.count("*").alias("documents"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("broken"))
    bins = fillings_of.where("bin_id IS NOT NULL").groupBy("container_id", "bin_id").agg(F.sum("tokens").alias("held"), F.min("room").alias("lo"), F.max("room").alias("hi")).join(kinds, "container_id")
    bad = bins.groupBy("container_id").agg(F.count_if(~((F.col("held") <= F.col("capacity")) & (F.col("capacity") - F.col("held") == F.col("lo")) & (F.col("lo") == F.col("hi")))).alias("overfull"))
    return documents.join(bad, "container_id", "left").na.fill(0, ["overfull"]).select("container_id", "documents", "broken", "overfull")
