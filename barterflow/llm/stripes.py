"""Which items appear together, and how much more often than chance (problem 1).

Stripes: each map task keeps, per item, an associative array from neighbour to the number
of records that hold both, and adds to it record after record. What crosses the network are
these arrays, cut into sections by a hash of the neighbour so that not all of one item's
neighbours need meet in one task; rows of one item and section are brought together in order and
merged key by key, one section in memory at a time. Pairs are never emitted record by record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barterflow.shared import materialised

#: Entries of all stripes of a task before they are handed on, pairs expanded at a time, and the vocabulary up to which counts are kept as a square.
HELD, AT_ONCE, SQUARE = 1 << 21, 1 << 21, 2048
#: Sections of an item's neighbours where the vocabulary is open.
SECTIONS = 64

STRIPE = "item string, section int, neighbours array<string>, counts array<bigint>"
COUNT = "item string, neighbour string, count bigint"


class Stripes:
    """The associative arrays of one task: counts by item code * width + neighbour code."""

    def __init__(self, only: Sequence[str] | None):
        self.names: list[str] = list(dict.fromkeys(only)) if only is not None else []
        self.code = {x: i for i, x in enumerate(self.names)}
        self.open = only is None
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.square: np.ndarray | None = None
        self.records = 0
        if self.open:
            self.names, self.code = [], {}

    def _codes(self, values: pa.Array) -> np.ndarray:
        d = values.dictionary_encode()
        local = np.full(len(d.dictionary) + 1, -1, np.int64)
        for i, name in enumerate(d.dictionary.to_pylist()):
            if name is None:
                continue
            if self.open and name not in self.code:
                self.code[name] = len(self.names)
                self.names.append(name)
            local[i] = self.code.get(name, -1)
        return local[pc.fill_null(d.indices, len(d.dictionary)).to_numpy(zero_copy_only=False)]

    def add(self, lists: pa.ListArray) -> None:
        """Adds records; items of a record count once, nulls and unknown names not at all."""
        self.records += len(lists)
        lists = pc.drop_null(lists)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        code = self._codes(flat)
        known = code >= 0
        width = max(1, len(self.names))
        both = np.unique(row[known] * width + code[known])
        row, code = both // width, both % width
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        size = np.diff(np.r_[begin, len(row)])
        cost = np.cumsum(size * size)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + AT_ONCE, "right")))
            self._expand(code[begin[i] : begin[j - 1] + size[j - 1]], size[i:j], width)
            i = j

    def _expand(self, code: np.ndarray, size: np.ndarray, width: int) -> None:
        """Adds each record's items to the stripe of each of its items (its own count among them)."""
        begin = np.cumsum(size) - size
        for lo in range(0, len(code), max(1, AT_ONCE // int(size.max()))):
            part = slice(lo, min(len(code), lo + max(1, AT_ONCE // int(size.max()))))
            owner = np.repeat(np.arange(len(size)), size)[part]
            n = size[owner]
            ends = np.cumsum(n)
            other = np.repeat(begin[owner] - (ends - n), n) + np.arange(int(ends[-1]))
            keys = np.repeat(code[part], n) * width + code[other]
            if not self.open and width <= SQUARE:
                if self.square is None:
                    self.square = np.zeros(width * width, np.int64)
                self.square += np.bincount(keys, minlength=width * width)
            else:
                self._merge(keys // width << 32 | keys % width)

    def _merge(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        both, where = np.unique(np.r_[self.keys, k], return_inverse=True)
        self.counts = np.bincount(where, np.r_[self.counts, n], len(both)).astype(np.int64)
        self.keys = both

    def full(self) -> bool:
        return len(self.keys) >= HELD

    def batch(self) -> pa.RecordBatch:
        """The stripes so far; the number of records stands in a row without item."""
        if self.square is not None:
            k = np.flatnonzero(self.square)
            item, other, count = k // len(self.names), k % len(self.names), self.square[k]
        else:
            item, other, count = self.keys >> 32, self.keys & 0xFFFFFFFF, self.counts
        # which section each neighbour is in
        section = np.fromiter((zlib.crc32(x.encode()) % SECTIONS for x in self.names), np.int64, len(self.names)) if self.open else np.zeros(len(self.names), np.int64)
        of = section[other]
        order = np.lexsort((of, item))
        item, other, count, of = item[order], other[order], count[order], of[order]
        names = np.array([*self.names, None], object)
        begin = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (of[1:] != of[:-1])]) if len(item) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[0, begin + 1, len(item) + 1] if len(item) else [0, 1], pa.int32())
        items = pa.array([None, *names[item[begin]]], pa.string())
        sections = pa.array(np.r_[0, of[begin]], pa.int32())
        neighbours = pa.ListArray.from_arrays(offsets, pa.array([None, *names[other]], pa.string()))
        counts = pa.ListArray.from_arrays(offsets, pa.array(np.r_[self.records, count], pa.int64()))
        self.clear()
        return pa.RecordBatch.from_arrays([items, sections, neighbours, counts], names=["item", "section", "neighbours", "counts"])


def partial_stripes(records: DataFrame, items: str, only: Sequence[str] | None = None) -> DataFrame:
    """Stripes of each task (map-side combining). ``only``: a vocabulary of bounded size; None: all names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes(only)
        for batch in batches:
            column = batch.column(0)
            for lo in range(0, len(column), 10_000):
                held.add(column.slice(lo, 10_000))
                if held.full():
                    yield held.batch()
        yield held.batch()

    return records.select(items).mapInArrow(run, STRIPE)


def merged_stripes(partial: DataFrame) -> DataFrame:
    """item, neighbour, count over all tasks: arrays of one item and section meet in one task, in order, and are added up key by key.

    A task holds the array it is merging and one batch of rows, whatever the number of tasks a hot item comes from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the last item and section so far, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pc.list_parent_indices(batch.column(2))
            flat = pa.table({"item": batch.column(0).take(own), "section": batch.column(1).take(own), "neighbour": pc.list_flatten(batch.column(2)), "count": pc.list_flatten(batch.column(3))})
            if held is not None:
                flat = pa.concat_tables([held, flat])
            flat = flat.group_by(["item", "section", "neighbour"]).aggregate([("count", "sum")]).rename_columns(["item", "section", "neighbour", "count"])
            item, section = batch.column(0)[-1], batch.column(1)[-1]
            same = pc.equal(flat["item"], item) if item.is_valid else pc.is_null(flat["item"])
            last = pc.fill_null(pc.and_(same, pc.equal(flat["section"], section)), False)
            held = flat.filter(last)
            yield from flat.filter(pc.invert(last)).select(["item", "neighbour", "count"]).combine_chunks().to_batches()
        if held is not None:
            yield from held.select(["item", "neighbour", "count"]).combine_chunks().to_batches()

    return partial.repartition("item", "section").sortWithinPartitions("item", "section").mapInArrow(run, COUNT)


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """G2 of the 2x2 table of two items over n records; 0 where they are independent."""

    def xlogx(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    cells = [n_ab, n_a - n_ab, n_b - n_ab, n - n_a - n_b + n_ab]
    margins = [n_a, n - n_a, n_b, n - n_b]
    total = sum((xlogx(c.cast("double")) for c in cells), F.lit(0.0)) - sum((xlogx(m.cast("double")) for m in margins), F.lit(0.0)) + xlogx(n.cast("double"))
    return F.greatest(F.lit(0.0), 2 * total)


def cooccurrence(records: DataFrame, items: str, only: Sequence[str] | None = None) -> DataFrame:
    """name_a < name_b, n_ab, n_a, n_b, n, lift, llr of every pair of items that some record holds both.

    n counts all records, also those with a null or empty list. An item counts once a record.
    No pair, no row. Marginals are joined by item: as many rows as items.
    """
    counts = materialised(merged_stripes(partial_stripes(records, items, only)), "stripes")
    n = counts.where("item IS NULL").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    own = counts.where("item = neighbour").select("item", F.col("count").alias("own"))
    a = own.select(F.col("item").alias("name_a"), F.col("own").alias("n_a"))
    b = own.select(F.col("item").alias("name_b"), F.col("own").alias("n_b"))
    pairs = counts.where("item < neighbour").select(F.col("item").alias("name_a"), F.col("neighbour").alias("name_b"), F.col("count").alias("n_ab"))
    out = pairs.join(a, "name_a").join(b, "name_b").withColumn("n", F.lit(n).cast("bigint"))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.withColumn("lift", lift).withColumn("llr", log_likelihood_ratio(*[F.col(c) for c in ("n_ab", "n_a", "n_b", "n")]))
