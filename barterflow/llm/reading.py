"""Reading level of each document by a Rasch-style model (problem 8).

A reader of ability t knows word w with probability 1 / (1 + exp(b_w - t)). The level of a
document is the ability at which the expected share of its word occurrences known is SHARE; the
difficulty of a word is where the expected share of its occurrences known to readers of the levels
of the documents it stands in is SHARE. Both equations are solved in turn: levels given
difficulties by Newton's method, document by document; difficulties given levels by a Newton step,
word by word. Grades anchor the scale (one grade, one logit): what a graded document's level
misses its grade by is shared among its words, and a straight line puts levels on the grades' scale.
Documents without a grade take part in every alternation over the corpus, all of them together
with UNGRADED of the weight of the graded ones, as their levels know less; to words that graded
documents hardly hold they alone give a difficulty.

Documents are cut into words once and written as word places and counts. An alternation is one
pass over that table; each task adds up sums by word and hands on one row a word. Words are hashed
to PLACES places, so the model that goes to every task has a bounded size whatever the corpus:
at most 12 bytes for each place that weighs. Words: runs of letters, or pairs of neighbouring
characters in scripts that write no blanks between words, and the length of each sentence on a log scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barterflow.shared import materialised

#: Places for words (the size of the model), the share of word occurrences a reader of a document's level knows, and the occurrences at the mean that a word's own are weighed against.
PLACES, SHARE, PRIOR = 1 << 20, 0.75, 4.0
#: Alternations over the graded documents first, then over all; Newton steps a level; the share of a document's evidence that holds a difficulty in place; the weight of all ungraded documents together to that of all graded ones.
GRADED_STEPS, STEPS, NEWTON, RIDGE, UNGRADED = 3, 3, 3, 0.3, 0.2
#: Occurrences from which graded documents decide how much a word weighs, and the weight of words they don't decide.
SEEN, UNSURE = 3, 0.3
#: The ability above a word's difficulty at which it is known with probability SHARE.
ABOVE = float(np.log(SHARE / (1 - SHARE)))
#: Bytes of text handled at a time.
SLICE_BYTES = 1 << 20

BREAK, WORD, DENSE, STOP = range(4)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point: letter of a script with blanks, letter of one without, end of a sentence, or none of these."""
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    kinds = np.zeros(0x110000, np.uint8)
    for what, kind in ((r"[\p{L}\p{M}'’]+", WORD), (r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー々]+", DENSE), (r"[.!?。！？．\n]+", STOP)):
        for m in regex.finditer(what, text):
            kinds[points[m.start() : m.end()]] = kind
    return kinds


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(cps: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word occurrence and the text it is in. ``owner``: the text of each character, rising."""
    cps = np.where((cps >= 65) & (cps <= 90), cps + 32, cps)
    kind = _kinds()[cps]
    n = len(cps)
    with np.errstate(over="ignore"):
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        k = kind[begin]
        at = np.arange(n) - np.repeat(begin, np.diff(np.r_[begin, n]))
        letters = _mixed(cps.astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32)))
        sums = np.add.reduceat(letters, begin) if n else np.zeros(0, np.uint64)
        word = k == WORD
        pair = np.flatnonzero((kind[:-1] == DENSE) & ~new[1:]) if n else np.zeros(0, np.int64)
        pairs = _mixed((cps[pair].astype(np.uint64) << np.uint64(21)) | cps[pair + 1])
        # sentences: characters between two stops of a text, on a scale of half doublings
        edge = np.ones(n, bool)
        edge[1:] = ((kind[1:] != STOP) & (kind[:-1] == STOP)) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge)
        size = np.diff(np.r_[first, n])
        dense = np.add.reduceat((kind == DENSE).astype(np.int64), first) if n else size
        scale = (np.log2(np.maximum(size, 1)) * 2).astype(np.uint64) + np.where(dense * 2 > size, np.uint64(100), np.uint64(0))
        places = np.r_[_mixed(sums[word]), pairs, _mixed(scale + np.uint64(1 << 62))] % np.uint64(PLACES)
        owners = np.r_[owner[begin[word]], owner[pair], owner[first]]
    return places.astype(np.int64), owners


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """From, to, place and text number of the word occurrences of an Arrow array of texts, a slice at a time; nulls have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1)
        lo, hi = int(bounds[i]), int(bounds[j])
        data = texts.buffers()[2].slice(lo, hi - lo).to_pybytes() if hi > lo else b""
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        owner = np.searchsorted(bounds[i : j + 1] - lo, lead, "right") - 1
        yield i, j, *words_of(cps, owner)
        i = j


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, places, counts: the places of each document's words, each once, and how often they occur; empty for null and wordless texts. No shuffle.

    Both are the bytes of little-endian 32-bit numbers: they pass between Spark and Python as they are, not number by number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, places, counts = [np.zeros(1, np.int64)], [], []
            for i, j, place, text_no in slices(batch.column(1)):
                both, n = np.unique(text_no.astype(np.int64) * PLACES + place, return_counts=True)
                places.append((both % PLACES).astype(np.int32))
                counts.append(n.astype(np.int32))
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(both // PLACES, minlength=j - i)))
            offsets = pa.array(np.concatenate(ends) * 4, pa.int32()).buffers()[1]
            lists = [pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer((np.concatenate(x) if x else np.zeros(0, np.int32)).astype("<i4").tobytes())]) for x in (places, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "places", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, places binary, counts binary")


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column of ``word_counts``, and how many each row has."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0])), "<i4") if len(column) and bounds[-1] > bounds[0] else np.zeros(0, np.int32)
    return data, np.diff(bounds) // 4


class Words:
    """The words of a batch of documents: place and count of each entry, and the document it is in."""

    def __init__(self, places: pa.Array, counts: pa.Array):
        self.docs = len(places)
        self.place, size = numbers(places)
        self.count = numbers(counts)[0].astype(np.float32)
        self.of = np.repeat(np.arange(self.docs), size)
        self.full = np.flatnonzero(size)
        self.begin = (np.cumsum(size) - size)[self.full]

    def by_doc(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.docs)
        if len(self.begin):
            out[self.full] = np.add.reduceat(x, self.begin)
        return out

    def by_place(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, x, PLACES)


def known(x: np.ndarray) -> np.ndarray:
    """The probability that a reader ``x`` above a word's difficulty knows it."""
    return 1 / (1 + np.exp(-x))


class Model:
    """Difficulty and weight of each place, and the line that puts raw levels on the grades' scale."""

    def __init__(self, n: np.ndarray, s: np.ndarray, ss: np.ndarray):
        """From occurrences, levels and squared levels by place. A word weighs by how much narrower its levels are than all levels."""
        self.n = n
        self.mean, spread = self._moments(n, s, ss)
        self.b, self.weight = self._words(n, s, ss, self.mean, spread)
        self.slope, self.shift = 1.0, 0.0

    @staticmethod
    def _moments(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> tuple[float, float]:
        total = max(n.sum(), 1.0)
        mean = s.sum() / total
        return mean, max(ss.sum() / total - mean**2, 0.05)

    @staticmethod
    def _words(n: np.ndarray, s: np.ndarray, ss: np.ndarray, mean: float, spread: float) -> tuple[np.ndarray, np.ndarray]:
        level = (s + PRIOR * mean) / (n + PRIOR)
        var = np.maximum((ss + PRIOR * (spread + mean**2)) / (n + PRIOR) - level**2, 0.02 * spread)
        return level - ABOVE, np.where(n > 0, (spread / var - 1.0).clip(0.0) + 1e-2, 0.0)

    def rare_words(self, n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> None:
        """Difficulty and weight of the words graded documents hardly hold, from sums of raw levels over all documents."""
        b, weight = self._words(n, s, ss, *self._moments(n, s, ss))
        rare = self.n < SEEN
        self.b, self.weight = np.where(rare, b, self.b), np.where(rare, weight * UNSURE, self.weight)

    def __getstate__(self) -> dict:
        """What goes to the tasks: places that weigh, in single precision; counts stay on the driver."""
        at = np.flatnonzero(self.weight).astype(np.int32)
        return {"at": at, "b": self.b[at].astype(np.float32), "w": self.weight[at].astype(np.float32), "line": (self.mean, self.slope, self.shift)}

    def __setstate__(self, state: dict) -> None:
        self.b, self.weight = np.zeros(PLACES), np.zeros(PLACES)
        self.b[state["at"]], self.weight[state["at"]] = state["b"], state["w"]
        self.mean, self.slope, self.shift = state["line"]

    def raw_levels(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The level of each document at which its words are known as expected, before the line, and the weight of evidence behind it."""
        b, weight = self.b[words.place].astype(np.float32), (self.weight[words.place] * words.count).astype(np.float32)
        total = words.by_doc(weight)
        safe = np.maximum(total, 1e-12)
        t = words.by_doc(weight * b) / safe + ABOVE
        for _ in range(NEWTON):
            p = known(t.astype(np.float32)[words.of] - b)
            found = weight * p
            slope = np.maximum(words.by_doc(found * (1 - p)) / safe, 1e-3)
            t = t - np.where(total > 0, np.clip((words.by_doc(found) / safe - SHARE) / slope, -1, 1), 0.0)
        return t, total

    def levels(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Levels on the grades' scale, the mean level where there is no evidence, and the evidence."""
        raw, w = self.raw_levels(words)
        return np.where(w > 0, raw * self.slope + self.shift, self.mean), w


#: Sums by place: share, share x level, share x grade of graded documents; occurrences, levels, squared levels of all; known too often and how fast that changes, of ungraded ones.
SUMS = ("share", "sx", "sy", "n", "s", "ss", "over", "rate")


def _gathered(rows: DataFrame, sums: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by place over all tasks, and one row of sums without place. ``sums`` adds a batch's to an array (sum, place) and returns the row.

    At most PLACES rows of eight numbers come to the driver, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, row = np.zeros((len(SUMS), PLACES)), np.zeros(len(SUMS))
        for batch in batches:
            row += sums(batch, total)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1], pa.int32()), *[pa.array(np.r_[x[at], r]) for x, r in zip(total, row)]], names=["place", *SUMS])

    t = rows.mapInArrow(run, "place int, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("place").agg(*[F.sum(c).alias(c) for c in SUMS]).toArrow()
    place, values = t["place"].to_numpy(), np.array([t[c].to_numpy() for c in SUMS])
    total, row = np.zeros((len(SUMS), PLACES)), np.zeros(len(SUMS))
    total[:, place[place >= 0]] = values[:, place >= 0]
    if (place < 0).any():
        row = values[:, place < 0].sum(axis=1)
    return total, row


def _begun(graded: DataFrame) -> Model:
    """A model from the grades of the documents that hold each word."""

    def sums(batch: pa.RecordBatch, total: np.ndarray) -> np.ndarray:
        words, y = Words(batch.column(0), batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        e = y[words.of]
        for k, x in enumerate((words.count, words.count * e, words.count * e * e)):
            total[3 + k] += words.by_place(x)
        return np.zeros(len(SUMS))

    return Model(*_gathered(graded.select("places", "counts", "grade"), sums)[0][3:6])


def _alternated(model: Model, rows: DataFrame, step: bool) -> Model:
    """Levels given difficulties, the line to the grades, then (``step``) difficulties given levels. Rows: places, counts, grade (null: none)."""

    def sums(batch: pa.RecordBatch, total: np.ndarray) -> np.ndarray:
        words = Words(batch.column(0), batch.column(1))
        y = pc.cast(batch.column(2), pa.float64()).to_numpy(zero_copy_only=False)
        x, w = model.raw_levels(words)
        graded, ok = ~np.isnan(y), w > 0
        anchor = np.where(graded & ok, np.nan_to_num(y), 0.0)
        if step:
            share = words.count * model.weight[words.place] / np.maximum(w, 1e-12)[words.of]
            mine, level = (graded & ok)[words.of], x[words.of]
            fair, free = np.where(mine, share, 0.0), np.where((~graded & ok)[words.of], share, 0.0)
            seen = np.where(ok[words.of], words.count, 0.0)
            p = known(level - model.b[words.place])
            slope = SHARE * (1 - SHARE)
            for k, v in enumerate((fair, fair * level, fair * anchor[words.of], seen, seen * level, seen * level * level, free * (p - SHARE) / slope, free * p * (1 - p) / slope)):
                total[k] += words.by_place(v)
        g = graded & ok
        return np.array([g.sum(), x[g].sum(), y[g].sum(), (x * y)[g].sum(), (x * x)[g].sum(), (~graded & ok).sum(), 0.0, 0.0])

    (share, sx, sy, n, s, ss, over, rate), (count, x, y, xy, xx, others, *_) = _gathered(rows.select("places", "counts", "grade"), sums)
    if count > 1 and xx - x * x / count > 1e-9 and xy - x * y / count > 0:
        model.slope = (xy - x * y / count) / (xx - x * x / count)
        model.shift = (y - model.slope * x) / count
    if step:
        each = UNGRADED * count / others if others else 0.0
        missed = sy - model.slope * sx - model.shift * share
        model.b = model.b + (missed + each * over) / (share + each * rate + RIDGE)
        if others:
            model.rare_words(n, s, ss)
    return model


def fitted(docs: DataFrame, graded: DataFrame, key: str, text: str, level: str) -> tuple[Model, DataFrame]:
    """The model of a corpus of which some documents have a level, and the corpus as key, grade, places, counts (written once).

    Without any grade all levels are equal. Several grades of one document are averaged.
    """
    own = graded.groupBy(key).agg(F.avg(F.col(level).cast("double")).alias("grade")).where(F.col("grade").isNotNull())
    corpus = materialised(word_counts(docs, key, text).join(own, key, "left").select(key, "grade", "places", "counts"), "words")
    some = corpus.where("grade IS NOT NULL")
    model = _begun(some)
    for _ in range(GRADED_STEPS):
        model = _alternated(model, some, True)
    for _ in range(STEPS):
        model = _alternated(model, corpus, True)
    return _alternated(model, some, False), corpus


def reading_levels(docs: DataFrame, graded: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """key, level (logits, 0 the middle grade), evidence of each document; null, empty and wordless texts get the mean level and evidence 0."""
    model, corpus = fitted(docs, graded, key, text, level)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, weight = model.levels(Words(batch.column(1), batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels), pa.array(weight)], names=[key, "level", "evidence"])

    return corpus.select(key, "places", "counts").mapInArrow(run, f"`{key}` {kind}, level double, evidence double")


def profile(levels: DataFrame) -> DataFrame:
    """band (1 to 5, by the nearest grade), docs, mean_level: how demanding the corpus is."""
    band = F.least(F.lit(5), F.greatest(F.lit(1), F.round(F.col("level") + 3).cast("int")))
    return levels.where("evidence > 0").groupBy(band.alias("band")).agg(F.count("*").alias("docs"), F.avg("level").alias("mean_level"))
