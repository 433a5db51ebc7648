"""Landed pages as a stream into the store of posts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from barterflow.operators.arrivals import SeenState
from barterflow.sources.pages import PAGE, accepted, entries, latest_by_id, parsed_entries


def page_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Pages as they land, as JSON lines; the schema is fixed, nothing is inferred."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_a_batch).json(path)


def ingest_pages(pages: DataFrame, store: str, checkpoint: str, names: Sequence[str], aliases: Sequence[tuple[str, str]]) -> StreamingQuery:
    """Appends the accepted posts of all pages there are to the store, every copy kept; a batch that is repeated replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        posts = accepted(parsed_entries(latest_by_id(entries(batch)), names, aliases))
        posts.select("id", "created_at", "demand", "supply", "run_id", "query").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingest_once(arrivals: DataFrame, state: str, out: str, checkpoint: str, id_col: str, order: list[str], row_id: str, shards: int = 64) -> StreamingQuery:
    """Writes each message of a stream exactly once, whatever batch its copies come in: bitmaps of what was seen are united after each batch.

    A batch that is repeated after a failure is known by the stream's id and its number, and its
    output is written again from what was committed for it. Several streams, one after another,
    may use one state; ``out`` belongs to one state.
    """
    spark = arrivals.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        seen = SeenState(spark, state, shards)
        version = seen.version_of(stream, number)
        if version is None:
            if exists(spark, folder := f"{out}/batch={seen.version()}"):
                raise ValueError(f"{folder} isn't from this state")
            version = seen.add(batch, id_col, order, row_id, stream, number)
        batch.join(seen.selected(version, row_id), row_id, "left_semi").write.mode("overwrite").parquet(f"{out}/batch={version - 1}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
