"""Images: their links in an entry, layout of decoded pixels, fingerprints of pixels, and the recogniser's protocol.

Decoding, resampling with a photographic kernel and character recognition need libraries that
aren't part of this engine; they come in through the protocols. What is decided from their
output is in barterflow.operators.consensus, fingerprint and evidence.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What makes a link an image.
KEY = regex.compile(r"image|img|photo|media|thumbnail|picture|large|orig", regex.I)
FILE = regex.compile(r"\.(?:jpe?g|png|webp)(?:[?#].*)?$", regex.I)
HOST = regex.compile(r"pbs\.twimg\.com|twimg\.com|img\.gamewith\.jp|yimg\.jp", regex.I)
FULL_SIZE_HOST, DEEPEST = "pbs.twimg.com", 8


class Recogniser(Protocol):
    """Reads an image: rows of pass, text, confidence, and whether the known layout was seen."""

    def __call__(self, content: bytes) -> list[tuple[int, str, float, bool]]: ...


def _leaves(value: object, key: str = "", depth: int = 0) -> Iterator[tuple[str, str]]:
    """(nearest key, text) of every text in a document, down to DEEPEST levels."""
    if isinstance(value, str):
        yield key, value
    elif depth < DEEPEST and isinstance(value, dict | list):
        for k, x in value.items() if isinstance(value, dict) else ((key, x) for x in value):
            yield from _leaves(x, k, depth + 1)


def _full_size(url: str) -> str:
    """The link to the largest version, on the host that keeps several."""
    u = urlsplit(url)
    query = dict(parse_qsl(u.query))
    return urlunsplit(u._replace(query=urlencode(query | {"name": "orig"}))) if u.hostname == FULL_SIZE_HOST and query.get("format") else url


def image_links(document: str | None) -> list[str]:
    """Distinct image links anywhere in a JSON document, down to a depth; [] for null and for what isn't JSON."""
    try:
        leaves = list(_leaves(json.loads(document))) if document else []
    except ValueError:
        return []
    links = [(k, s.replace("\\u002F", "/").replace("&amp;", "&")) for k, s in leaves]
    links = [(k, s) for k, s in links if s[:8].lower().startswith(("http://", "https://"))]
    return list(dict.fromkeys(_full_size(s) for k, s in links if FILE.search(s) or HOST.search(s) or KEY.search(k)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def image_urls(documents: pd.Series) -> pd.Series:
    """Image links of JSON documents; depth is unknown, which SQL paths can't walk."""
    return documents.map(image_links)


def stretches(scores: np.ndarray, least: float, rows: int) -> list[tuple[int, int, float]]:
    """First, last and mean score of each stretch of rows at or above ``least``, ``rows`` long or longer."""
    hit = np.r_[False, scores >= least, False]
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    return [(int(a), int(b) - 1, float(scores[a:b].mean())) for a, b in zip(edge[::2], edge[1::2]) if b - a >= rows]


def trade_layout(pixels: np.ndarray) -> dict | None:
    """Bands of a trade sheet in decoded pixels (height x width x 3): a pink heading above a blue one, a black foot; null where there is none."""
    height, width = pixels.shape[:2]
    if width < 240 or height < 180 or pixels.ndim < 3 or pixels.shape[2] < 3:
        return None
    r, g, b = (pixels[:, :: 2 if width > 700 else 1, i].astype(float) for i in range(3))
    pink = ((r >= 175) & (r - g >= 25) & (b >= 65) & ((r + b) / 2 - g >= 18)).mean(1)
    blue = ((b >= 145) & (g >= 90) & (b - r >= 35) & (g - r >= 25)).mean(1)
    dark = ((r <= 28) & (g <= 28) & (b <= 28)).mean(1)
    rows = max(5, int(height * 0.005 + 0.5))
    pairs = [(p[2] + q[2], p, q) for p in stretches(pink, 0.36, rows) for q in stretches(blue, 0.36, rows) if q[0] > p[1] and height * 0.05 <= q[0] - p[1] <= height * 0.72]
    if not pairs:
        return None
    score, p, q = max(pairs, key=lambda x: x[0])
    foot = next((s for s in stretches(dark, 0.88, max(8, int(height * 0.01 + 0.5))) if s[0] > q[1] + height * 0.08), None)
    return {"confidence": min(1.0, score / 1.5), "pink_top": p[0] / height, "pink_bottom": (p[1] + 1) / height, "blue_top": q[0] / height, "blue_bottom": (q[1] + 1) / height, "content_bottom": foot[0] / height if foot else 1.0}


def _shrunk(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area means of a picture (a plain kernel; a photographic one can be passed to ``pixel_fingerprint``)."""
    ys, xs = np.linspace(0, x.shape[0], rows + 1), np.linspace(0, x.shape[1], cols + 1)
    cells = [[x[int(a) : max(int(a) + 1, int(b)), int(c) : max(int(c) + 1, int(d))].mean((0, 1)) for c, d in zip(xs[:-1], xs[1:])] for a, b in zip(ys[:-1], ys[1:])]
    return np.array(cells)


def pixel_fingerprint(pixels: np.ndarray, shrink: Callable[[np.ndarray, int, int], np.ndarray] = _shrunk) -> tuple[bytes, bytes] | None:
    """Grey (24x24) and colour (12x12x3) bytes of a picture's middle; null below 24 x 32 pixels."""
    h, w = pixels.shape[:2]
    if w < 24 or h < 32:
        return None
    left, top = round(w * 0.08), round(h * 0.12)
    crop = pixels[top : top + max(20, min(h - top, round(h * 0.62))), left : left + max(16, min(w - left, round(w * 0.84))), :3].astype(float)
    gray = crop @ np.array([0.2126, 0.7152, 0.0722])
    lo, hi = np.percentile(gray, [1, 99])
    gray = np.clip((gray - lo) / (hi - lo or 1.0) * 255, 0, 255)
    to = lambda x: np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()
    return to(shrink(gray[..., None], 24, 24)), to(shrink(crop, 12, 12))


READING = "path string, `pass` int, text string, confidence double, layout boolean, error string"


def readings(images: DataFrame, recogniser: Callable[[], Recogniser], task_seconds: float | None = None) -> DataFrame:
    """path, pass, text, confidence, layout, error of each image; the recogniser is made once a task.

    An image it fails on has one row of nulls with the error's kind and text; so has one that a task reaches after
    ``task_seconds`` of recognition, with 'budget' (None: no budget). A recogniser that cannot be made fails the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, began = recogniser(), time.monotonic()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if task_seconds is not None and time.monotonic() - began > task_seconds:
                    rows.append((path, None, None, None, None, "budget"))
                    continue
                try:
                    rows += [(path, *x, None) for x in read(content)]
                except Exception as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = zip(*rows) if rows else [()] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "pass", "text", "confidence", "layout", "error"])

    return images.select("path", "content").mapInArrow(run, READING)
