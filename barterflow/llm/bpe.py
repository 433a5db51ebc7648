"""Byte-pair encoding of a corpus with a public byte-level vocabulary (problem 6).

A text is cut into pieces as the vocabulary's pattern says, and a piece again between two
bytes that stand side by side in no token: no merge can cross there, so the parts are
encoded on their own. Each distinct part is encoded once a worker by a segment tree over its
bytes, which holds the rank of each live neighbour pair and at its root the leftmost least
one; a merge changes two pairs, so it costs two walks to the root. Everything around that
is NumPy over whole Arrow batches; no text becomes a Python string.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: The pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text handled at a time (a longer text is handled alone), and the distinct parts a worker remembers before it starts over.
SLICE_BYTES, REMEMBER = 1 << 20, 1 << 20

TOKENIZERS = "/opt/tokenizers"
_FREE = 1 << 62
OTHER, LETTER, NUMBER, SPACE = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_part(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of ``part``: the leftmost pair of least rank is merged until no pair is a token."""
    n = len(part)
    if part in ranks:
        return [ranks[part]]
    size = 1 << max(1, (n - 1).bit_length())
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of live positions: the next one, the one before
    tree = [_FREE] * (2 * size)

    def rank(i: int) -> int:
        j = after[i]
        r = ranks.get(part[i : after[j]]) if j < n else None
        return _FREE if r is None else r << 32 | i  # the position below the rank: equal ranks go by the leftmost

    for i in range(n - 1):
        tree[size + i] = rank(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    while tree[1] != _FREE:
        i = tree[1] & 0xFFFFFFFF
        dead = after[i]
        after[i] = j = after[dead]
        if j < n:
            before[j] = i
        put(dead, _FREE)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i : after[i]]])
        i = after[i]
    return out


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point, as the pattern's own engine sees it."""
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    classes = np.zeros(0x110000, np.uint8)
    for what, mark in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(what, text):
            classes[points[m.start() : m.end()]] = mark
    return classes


class Grown:
    """An array that is added to at its end; its room doubles, so adding costs what is added."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(max(end, 2 * len(self.room)) - self.size, self.room.dtype)])
        self.room[self.size : end] = more
        self.size = end

    def values(self) -> np.ndarray:
        return self.room[: self.size]


class Encoder:
    """Encodes Arrow string arrays under one vocabulary; remembers what it encoded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        together = np.zeros(65536, bool)
        for token in ranks:
            t = np.frombuffer(token, np.uint8).astype(np.int64)
            together[t[:-1] * 256 + t[1:]] = True
        self.apart = ~together
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.fresh, self.fresh_slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.long: dict[bytes, int] = {}
        self._flat, self._starts, self._counts = Grown(np.int32), Grown(np.int64), Grown(np.int32)

    @property
    def flat(self) -> np.ndarray:
        return self._flat.values()

    @property
    def starts(self) -> np.ndarray:
        return self._starts.values()

    @property
    def counts(self) -> np.ndarray:
        return self._counts.values()

    def _learn(self, parts: list[bytes]) -> int:
        """Encodes new parts; the slot of the first, the rest follow."""
        ids = [merge_part(p, self.ranks) for p in parts]
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        first = len(self.counts)
        self._starts.add(len(self.flat) + np.cumsum(counts, dtype=np.int64) - counts)
        self._counts.add(counts)
        self._flat.add(np.fromiter((x for y in ids for x in y), np.int32, int(counts.sum())))
        return first

    def _piece_starts(self, cps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters begin a piece; ``first``: which begin a text."""
        n = len(cps)
        kind = char_classes()[cps]
        blank = kind == SPACE
        begins = first.copy()
        begins[1:] |= kind[1:] != kind[:-1]
        last = np.ones(n, bool)  # of its run of blanks or others
        last[:-1] = begins[1:]
        ends_text = np.ones(n, bool)
        ends_text[:-1] = first[1:]
        start = begins | (blank & last & ~ends_text)
        joins = (cps == 32) & last & ~ends_text  # the blank that the next piece takes along
        at = np.flatnonzero(joins) + 1
        start[at] = False
        quote = np.flatnonzero((cps == 39) & start)
        if len(quote):
            text_no = np.cumsum(first)
            padded = np.r_[cps, np.zeros(3, cps.dtype)]
            owner = np.r_[text_no, np.zeros(3, text_no.dtype)]
            a, b = padded[quote + 1], padded[quote + 2]
            same1, same2 = owner[quote + 1] == owner[quote], owner[quote + 2] == owner[quote]
            one = same1 & np.isin(a, [ord(c) for c in "stmd"])
            two = same2 & (((np.isin(a, [ord("r"), ord("v")])) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            for hit, step in ((one, 2), (two & ~one, 3)):
                q = quote[hit]
                start[q + 1] = False
                q = q[q + step < n] + step
                start[q] = True
        return start

    def _slots(self, data: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each part, and the byte it begins at. ``first``: the bytes at which texts begin, each once, all of texts that aren't empty."""
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        opens = np.zeros(len(raw), bool)
        opens[first] = True
        begins = lead[self._piece_starts(cps, opens[lead])]
        cut = np.zeros(len(raw), bool)
        cut[begins] = True
        cut[1:] |= self.apart[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        at = np.flatnonzero(cut)
        size = np.diff(np.r_[at, len(raw)])
        words = np.empty(len(raw), np.uint64)
        padded = data + bytes(16)
        for k in range(8):
            part = words[k::8]
            part[:] = np.frombuffer(padded, "<u8", len(part), k)
        short = size <= 7
        s = size[short].astype(np.uint64)
        keys = (words[at[short]] & ((np.uint64(1) << (s * np.uint64(8))) - np.uint64(1))) | (s << np.uint64(56))
        slot = np.empty(len(at), np.int64)
        slot[short] = self._short(keys)
        rest = np.flatnonzero(~short)
        if len(rest):
            a = at[rest].tolist()
            b = (at[rest] + size[rest]).tolist()
            parts = [data[i:j] for i, j in zip(a, b)]
            fresh = [p for p in dict.fromkeys(parts) if p not in self.long]
            if fresh:
                k = self._learn(fresh)
                self.long.update(zip(fresh, range(k, k + len(fresh))))
            slot[rest] = np.fromiter(map(self.long.__getitem__, parts), np.int64, len(parts))
        return slot, at

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where it isn't known."""
        out = np.full(len(keys), -1, np.int64)
        for known, slots in ((self.keys, self.slots), (self.fresh, self.fresh_slots)):
            if len(known):
                k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[k] == keys, slots[k], out)
        return out

    def _short(self, keys: np.ndarray) -> np.ndarray:
        slots = self._find(keys)
        missing = slots < 0
        if missing.any():
            self._add(np.unique(keys[missing]))
            slots[missing] = self._find(keys[missing])
        return slots

    def _add(self, keys: np.ndarray) -> None:
        """New keys go to the smaller sorted part; it is merged into the larger one when it has a quarter of its size."""
        parts = [int(x & 0xFFFFFFFFFFFFFF).to_bytes(7, "little")[: int(x) >> 56] for x in keys.tolist()]
        k = self._learn(parts)
        both = np.r_[self.fresh, keys]
        order = np.argsort(both, kind="stable")
        self.fresh, self.fresh_slots = both[order], np.r_[self.fresh_slots, np.arange(k, k + len(keys))][order]
        if len(self.fresh) * 4 > len(self.keys):
            both = np.r_[self.keys, self.fresh]
            order = np.argsort(both, kind="stable")
            self.keys, self.slots = both[order], np.r_[self.slots, self.fresh_slots][order]
            self.fresh, self.fresh_slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each text, and the ids of all texts one after the other; none for an empty and for a null text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        buffer = texts.buffers()[2]
        counts, out, i = np.zeros(n, np.int64), [], 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1)
            lo, hi = int(bounds[i]), int(bounds[j])
            if hi > lo:
                if len(self.counts) > REMEMBER:
                    self.forget()
                data = buffer.slice(lo, hi - lo).to_pybytes()
                begin = bounds[i:j] - lo
                full = np.diff(bounds[i : j + 1]) > 0
                slot, at = self._slots(data, begin[full])
                each = self.counts[slot]
                edges = np.searchsorted(at, begin[full])
                counts[i:j][full] = np.add.reduceat(each, edges, dtype=np.int64)
                if ids:
                    ends = np.cumsum(each, dtype=np.int64)
                    out.append(self.flat[np.repeat(self.starts[slot] - (ends - each), each) + np.arange(int(ends[-1]))])
            i = j
        return counts, (np.concatenate(out) if out else np.zeros(0, np.int32)) if ids else None


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(read_ranks(path))


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary to the executors, which need not have it where the driver does; returns the name it has there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def own_encoder(vocabulary: str) -> Encoder:
    """The worker's encoder of a vocabulary that was shipped."""
    return encoder(SparkFiles.get(vocabulary))


def vocabulary_path(name: str, folder: str = TOKENIZERS) -> str:
    path = os.path.join(folder, f"{name}.tiktoken")
    if not os.path.exists(path):
        raise ValueError(f"no byte-level vocabulary {name!r} in {folder}")
    return path


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row: an empty list for an empty and for a null text. No shuffle."""

    vocabulary = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_encoder(vocabulary)
        for batch in batches:
            counts, ids = own.encode(batch.column(1))
            # lists of at most 2^31 ids: a batch has a bounded number of rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str, vocabulary: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``key`` and ``to``: the text of each row's ids; '' for an empty and for a null list. The inverse of ``encode_corpus``. No shuffle.

    Ids that make no UTF-8 text, which no encoding of a text gives, have replacement characters there.
    """

    vocabulary = shipped(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sorted((i, t) for t, i in own_encoder(vocabulary).ranks.items())
        flat = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        size = np.zeros(tokens[-1][0] + 1, np.int64)
        size[[i for i, _ in tokens]] = [len(t) for _, t in tokens]
        start = np.cumsum(size) - size
        for batch in batches:
            lists = batch.column(1)
            own = lists.flatten().to_numpy(zero_copy_only=False)
            n = size[own]
            ends = np.cumsum(n)
            data = flat[np.repeat(start[own] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
            per = np.bincount(pc.list_parent_indices(lists).to_numpy(), n, len(lists)).astype(np.int64)
            bounds = np.r_[0, np.cumsum(per)].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])], pa.string())], names=[key, to])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{to}` string")


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key`` and ``tokens`` (bigint) of each row; 0 for an empty and for a null text. No shuffle."""

    vocabulary = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_encoder(vocabulary)
        for batch in batches:
            counts, _ = own.encode(batch.column(1), ids=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens bigint")
