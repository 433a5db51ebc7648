"""Files in and out: JSON documents, configuration, tables, the published snapshot, images."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_IMAGE_BYTES = 12 * 1024 * 1024


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents under a schema; an empty table where the path isn't there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_document(path: str, fallback: object) -> object:
    """A small JSON document on the driver; any error gives the fallback."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return fallback


def write_document(path: str, data: object) -> None:
    """A small JSON document, replaced as a whole."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    draft = f"{path}.draft"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
        f.write("\n")
    os.replace(draft, path)


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


#: Tuning where a file leaves it out (hours, pages, results, milliseconds, images, passes, scores).
TUNING = {
    "rankingHorizonHours": 168, "storageHorizonHours": 192, "autoBackfillEveryHours": 24, "recentPagesPerQuery": 10, "broadBackfillPagesPerQuery": 30, "cardBackfillPagesPerQuery": 10,
    "resultsPerPage": 40, "throttleMs": 90000, "queryThrottleMs": 180000, "retryCount": 0, "imageOcrEnabled": True, "imageOcrMaxImagesPerPost": 4, "imageOcrMaxNewImagesPerRun": 1000,
    "imageOcrTimeoutMs": 60000, "imageOcrCacheHours": 216, "imageOcrMaxCandidatePasses": 12, "imageOcrProcessingBudgetMs": 10800000, "imageMatchEnabled": True, "imageMatchRefreshHours": 24,
    "imageMatchStrongScore": 0.92, "imageMatchAgreeScore": 0.8, "imageMatchMinMargin": 0.035, "imageMatchStrongMargin": 0.055,
}


@dataclass(frozen=True)
class Config:
    """Dictionary, searches and tuning, with the values used where a file leaves them out."""

    cards: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    queries: tuple[str, ...] = ()
    tuning: dict = field(default_factory=TUNING.copy)

    @staticmethod
    def load(folder: str) -> Config:
        cards = read_document(f"{folder}/cards.json", {})
        queries = read_document(f"{folder}/queries.json", {})
        return Config(tuple(cards.get("cards", ())), tuple((cards.get("aliases") or {}).items()), tuple(queries.get("queries", ())), TUNING | read_document(f"{folder}/history.json", {}))


#: Names a dictionary may have that goes into expressions; more are refused.
MOST_NAMES = 10_000


def dictionary(cards: DataFrame) -> tuple[list[str], list[tuple[str, str]]]:
    """Names and aliases of a dictionary table, of all its rows (one, as a rule), each name once; aliases keep their order in a row.

    What is made of them is an expression, so at most MOST_NAMES names and as many aliases come; more are a ValueError.
    """
    names = [r.x for r in cards.select(F.explode("cards").alias("x")).where("x <> ''").limit(MOST_NAMES + 1).collect()]
    aliases = [(r.alias, r.canonical) for r in cards.select(F.explode("aliases").alias("a")).select("a.*").where("alias <> ''").limit(MOST_NAMES + 1).collect()]
    if max(len(names), len(aliases)) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names or aliases")
    return list(dict.fromkeys(names)), aliases


def snapshot(rankings: DataFrame, totals: DataFrame, coverage: DataFrame, now: datetime, source: dict | None = None, cards: dict | None = None, state: dict | None = None, discovered: int = 0, queries: int = 0, errors: list | None = None) -> dict:
    """The published document: at most windows x names rows, which the driver can hold.

    ``source`` and ``cards`` describe where posts come from and the dictionary, as they are to be shown; ``state`` is that of
    the runs (firstSuccessfulCollectionAt, lastBackfill, imageOcr), of which the first time is now where posts came first.
    """
    windows: dict[str, dict] = {}
    for r in totals.collect():
        windows[r.window_key] = {"hours": r.hours, "posts": r.posts, "totalDemand": r.total_demand, "totalSupply": r.total_supply, "totalRatio": {"ratio": r.total_ratio, "ratioDisplay": r.total_ratio_display, "ratioSort": r.total_ratio_sort}, "rankings": []}
    for r in rankings.orderBy("window_key", "rank").collect():
        windows[r.window_key]["rankings"].append({"rank": r["rank"], "name": r.name, "demand": r.demand, "supply": r.supply, "ratio": r.ratio, "ratioDisplay": r.ratio_display, "ratioSort": r.ratio_sort, "imbalance": r.imbalance})
    c = coverage.first()
    iso = lambda t: t and t.isoformat()
    state = state or {}
    first = state.get("firstSuccessfulCollectionAt") or (now.isoformat() if c.stored else None)
    about = {"firstSuccessfulCollectionAt": first, "oldestPostAt": iso(c.oldest), "newestPostAt": iso(c.newest), "storedPosts": c.stored, "discoveredThisRun": discovered, "queryCount": queries, "errors": errors or [], "history": state.get("lastBackfill"), "imageOcr": state.get("imageOcr")}
    return {"generatedAt": now.isoformat(), "source": source or {}, "cards": cards or {}, "coverage": about, "windows": windows}


def next_state(state: dict, document: dict) -> dict:
    """The state of the runs after ``document`` was published."""
    about = document["coverage"]
    return state | {"firstSuccessfulCollectionAt": about["firstSuccessfulCollectionAt"], "lastRunAt": document["generatedAt"], "lastRunDiscovered": about["discoveredThisRun"], "lastRunErrors": about["errors"]}


def read_images(spark: SparkSession, path: str, most_bytes: int = MOST_IMAGE_BYTES) -> DataFrame:
    """path, length, content of image files up to a size; the length filter reaches the scan, larger files aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp}").load(path).where(F.col("length") <= most_bytes).select("path", "length", "content")
