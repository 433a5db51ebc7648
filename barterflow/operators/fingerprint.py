"""Visual fingerprints compared with a reference set.

A fingerprint is 24x24 grey and 12x12 colour bytes. Similarity to every reference is
matrix arithmetic: vectors are centred and scaled once, then one product a batch. The
references go to every task, so their number is bounded and checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAY, COLOR = (24, 24), (12, 12, 3)
#: Weights of grey levels, edges and colour; references that go to every task (1,000 bytes each) at most.
WEIGHTS, MOST_REFERENCES = (0.50, 0.32, 0.18), 50_000


def edges(gray: np.ndarray) -> np.ndarray:
    """Steps to the right and down of each pixel but the last row's and column's, tripled, at most 255. ``gray``: n x 24 x 24."""
    g = gray.astype(np.int64)
    right = np.minimum(255, np.abs(g[:, :-1, 1:] - g[:, :-1, :-1]) * 3)
    down = np.minimum(255, np.abs(g[:, 1:, :-1] - g[:, :-1, :-1]) * 3)
    return np.stack([right, down], -1).reshape(len(g), -1)


def standard(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and deviation 1; a flat row stays 0."""
    x = x.reshape(len(x), -1).astype(float)
    x = x - x.mean(1, keepdims=True)
    sd = np.sqrt((x * x).mean(1, keepdims=True))
    return x / np.where(sd == 0, 1.0, sd)


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of each row of ``a`` with each of ``b``, from -1 to 1."""
    return np.clip(standard(a) @ standard(b).T / a.reshape(len(a), -1).shape[1], -1, 1)


def mean_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean absolute difference of byte rows over 255, at most 1, each with each."""
    a, b = a.reshape(len(a), -1).astype(float), b.reshape(len(b), -1).astype(float)
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):  # a row at a time: memory stays that of the references
        out[i] = np.abs(b - row).mean(1)
    return np.minimum(1, out / 255)


def similarity(gray: np.ndarray, color: np.ndarray, ref_gray: np.ndarray, ref_color: np.ndarray) -> np.ndarray:
    """From 0 to 1, each fingerprint with each reference."""
    g, e, c = WEIGHTS
    s = (correlation(gray, ref_gray) + 1) / 2 * g + (correlation(edges(gray), edges(ref_gray)) + 1) / 2 * e + (1 - mean_difference(color, ref_color)) * c
    return np.clip(s, 0, 1)


def decoded(prints: DataFrame) -> DataFrame:
    """Fingerprints whose gray and color are base64 text, as bytes; text that is no base64 gives null."""
    return prints.withColumns({c: F.try_to_binary(c, F.lit("base64")) for c in ("gray", "color")})


def encoded(prints: DataFrame) -> DataFrame:
    return prints.withColumns({c: F.base64(c) for c in ("gray", "color")})


def unpacked(column: list[bytes | None], shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as arrays, and which of them have the right length; the others are zeros."""
    size = int(np.prod(shape))
    ok = np.array([b is not None and len(b) == size for b in column], bool)
    flat = b"".join(b if good else bytes(size) for b, good in zip(column, ok))
    return np.frombuffer(flat, np.uint8).reshape(-1, *shape), ok


def ranked_matches(prints: DataFrame, references: DataFrame, keep: int = 2) -> DataFrame:
    """id, rank, canonical, score: the ``keep`` best names for each fingerprint, a name by its best reference.

    ``prints``: id string, gray, color binary; ``references``: canonical, gray, color. A fingerprint of the
    wrong size has similarity 0 to all; a reference without a name or of the wrong size is left out. Ties go by name.
    """
    refs = references.where("canonical IS NOT NULL AND gray IS NOT NULL AND color IS NOT NULL").select("canonical", "gray", "color").limit(MOST_REFERENCES + 1).toArrow()
    if len(refs) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references; block them first, by a coarse colour key for instance")
    (rg, ok1), (rc, ok2) = unpacked(refs["gray"].to_pylist(), GRAY), unpacked(refs["color"].to_pylist(), COLOR)
    good = ok1 & ok2
    rg, rc = rg[good], rc[good]
    names, owner = np.unique(np.array(refs["canonical"].to_pylist(), object)[good].astype(str), return_inverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                (g, a), (c, b) = unpacked(part.column(1).to_pylist(), GRAY), unpacked(part.column(2).to_pylist(), COLOR)
                if not len(names) or not len(g):
                    continue
                s = np.where((a & b)[:, None], similarity(g, c, rg, rc), 0.0)
                best = np.zeros((len(s), len(names)))
                np.maximum.at(best.T, owner, s.T)
                order = np.lexsort((np.broadcast_to(np.arange(len(names)), best.shape), -np.round(best, 12)))[:, :keep]
                k = order.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(part.column(0).to_pylist(), object), k)), pa.array(np.tile(np.arange(1, k + 1), len(s)), pa.int32()), pa.array(names[order].ravel()), pa.array(np.take_along_axis(best, order, 1).ravel())],
                    names=["id", "rank", "canonical", "score"],
                )

    return prints.select("id", "gray", "color").mapInArrow(run, "id string, rank int, canonical string, score double")


def best_two(ranked: DataFrame) -> DataFrame:
    """id, best, best_score, second_score, margin of each fingerprint."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    out = ranked.groupBy("id").agg(at(1, "canonical").alias("best"), at(1, "score").alias("best_score"), at(2, "score").alias("second_score"))
    return out.withColumn("margin", F.col("best_score") - F.coalesce("second_score", F.lit(0.0)))


def nearest_vectors(vectors: DataFrame, references: DataFrame, keep: int = 2) -> DataFrame:
    """id, rank, ref, score: the ``keep`` references with the highest Pearson correlation to each float vector; ties by ref.

    ``vectors``: id bigint, v array<float>; ``references``: ref bigint, v, bounded like fingerprints. Vectors that are null, of another length or with nulls have score -1 to all.
    """
    refs = references.where("v IS NOT NULL").select("ref", "v").orderBy("ref").limit(MOST_REFERENCES + 1).collect()
    if len(refs) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references")
    ids, r = np.array([x.ref for x in refs], np.int64), np.array([x.v for x in refs], float)
    size = r.shape[1] if len(r) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            ok = np.array([v is not None and len(v) == size and None not in v for v in rows], bool)
            if not size or not len(rows):
                continue
            x = np.array([v if good else [0.0] * size for v, good in zip(rows, ok)], float)
            s = np.where(ok[:, None], correlation(x, r), -1.0)
            order = np.argsort(-np.round(s, 12), 1, "stable")[:, :keep]
            k = order.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k)), pa.array(np.tile(np.arange(1, k + 1), len(s)), pa.int32()), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())],
                names=["id", "rank", "ref", "score"],
            )

    return vectors.select("id", "v").mapInArrow(run, "id bigint, rank int, ref bigint, score double")
