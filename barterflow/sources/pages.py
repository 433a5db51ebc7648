"""Landed pages of a search: entries, cursors, paging of a query, summaries, budgets.

Nothing is fetched here. Pages land as JSON or Parquet; a page source for tests or a crawler
is any callable that yields pages.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barterflow.functions.text import entry_time, entry_url, strip_highlight
from barterflow.operators.extract import BODY_MARK, body_text, segments, two_sided
from barterflow.operators.store import first_wins, last_wins

ENTRY = "struct<id:string,url:string,screenName:string,createdAt:bigint,displayTextBody:string,text:string>"
PAGE = f"page_id bigint, query string, run_id bigint, fetched_at timestamp, timeline struct<head:struct<oldestTweetId:string>,entry:array<{ENTRY}>>"
MOST_RESULTS = 40
#: Pages a run and a day may read.
PAGES_A_RUN, PAGES_A_DAY = 12, 72


class AccessBlocked(Exception):
    """The source refuses; not to be tried again."""


class PageSource(Protocol):
    def __call__(self, query: str, cursor: str | None, results: int) -> dict: ...


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON files, one page a line or a file; unreadable ones are null rows and left out."""
    return spark.read.schema(PAGE).option("mode", "PERMISSIVE").json(path).where("timeline IS NOT NULL")


def fetched(source: PageSource, query: str, cursor: str | None = None, results: int = MOST_RESULTS, retries: int = 0, wait: Callable[[int], None] = lambda ms: None) -> dict:
    """One page; results from 1 to 40, errors tried again after a growing wait, a refusal not."""
    for attempt in range(retries + 1):
        try:
            return source(query, cursor, max(1, min(MOST_RESULTS, results)))
        except AccessBlocked:
            raise
        except Exception:
            if attempt == retries:
                raise
            wait(1200 * (attempt + 1))
    raise AssertionError("unreachable")


def entries(pages: DataFrame) -> DataFrame:
    """page_id, query, run_id, fetched_at, pos and the fields of each entry; pages without entries have no row.

    An entry's body is its displayTextBody, else its text where entries have such a field.
    """
    fields = pages.schema["timeline"].dataType["entry"].dataType.elementType.names
    body = F.coalesce(*[F.col(f"e.{c}") for c in ("displayTextBody", "text") if c in fields])
    keys = [c for c in ("page_id", "query", "run_id", "fetched_at") if c in pages.columns]
    e = pages.select(*keys, F.posexplode("timeline.entry").alias("pos", "e")).where("e IS NOT NULL")
    return e.select(*keys, "pos", F.col("e.id").alias("id"), F.col("e.url").alias("url"), F.col("e.screenName").alias("screen_name"), F.col("e.createdAt").alias("created_raw"), body.alias("body"))


def cursors(pages: DataFrame, *more: Column | str) -> DataFrame:
    """page_id, query, run_id, entries, next_cursor: the head's cursor, else the last entry's id, else null; and ``more`` of the page."""
    entry = F.col("timeline.entry")
    last = F.when(F.size(entry) > 0, F.element_at(entry, -1)["id"])
    head = F.nullif(F.col("timeline.head.oldestTweetId"), F.lit(""))
    return pages.select("page_id", "query", "run_id", F.coalesce(F.when(entry.isNotNull(), F.size(entry)), F.lit(0)).alias("entries"), F.coalesce(head, F.nullif(last, F.lit(""))).alias("next_cursor"), *more)


def parsed_entries(found: DataFrame, names: Sequence[str], aliases: Sequence[tuple[str, str]], rejected: Callable[[Column], Column] | None = None) -> DataFrame:
    """Entries with body cleaned, created_at, url, author, demand, supply, explicit; those without id or time are left out.

    ``rejected``: whether a body as it came (without highlight marks) counts for nothing; such entries are left out before
    anything is parsed or recognised.
    """
    if rejected is not None:
        found = found.where(~F.coalesce(rejected(strip_highlight(F.coalesce("body", F.lit("")))), F.lit(False)))
    e = found.where("id <> ''").withColumn("created_at", entry_time("created_raw", "id")).where("created_at IS NOT NULL")
    e = e.withColumn("body", strip_highlight(F.coalesce("body", F.lit("")))).withColumn("link", entry_url("url", "screen_name", "id"))
    rest = [c for c in e.columns if c not in ("url", "link", "screen_name", "created_raw")]
    # unfolding an array of one keeps filters on what was parsed above the parsing: it runs once a row
    e = e.withColumn("__parts", F.explode(F.array(segments(body_text("body"), BODY_MARK))))
    e = e.withColumn("__parsed", F.explode(F.array(F.struct(*two_sided(F.col("__parts"), names, aliases)))))
    return e.select(*rest, F.col("link").alias("url"), F.col("screen_name").alias("author"), "__parsed.*")


def accepted(parsed: DataFrame) -> DataFrame:
    """Entries that state both sides, name something known and can be linked to."""
    return parsed.where("explicit AND (size(demand) > 0 OR size(supply) > 0) AND url IS NOT NULL")


def latest_by_id(rows: DataFrame) -> DataFrame:
    """The last entry of each id within a run and query: the later page, then the later place."""
    return last_wins(rows, ["run_id", "query", "id"], [F.col("fetched_at"), F.col("page_id"), F.col("pos")])


def reused(found: DataFrame, known: DataFrame, rejected: str) -> DataFrame:
    """Entries with the demand and supply of the first known post of their id (by time, then column seq if there, else the lists), unless column ``rejected`` says their text may not be reused; ``reused`` tells."""
    seq = ["seq"] if "seq" in known.columns else []
    memo = first_wins(known.select("id", "demand", "supply", "created_at", *seq), ["id"], [F.col("created_at").isNull(), F.col("created_at"), *map(F.col, seq or ["demand", "supply"])]).select("id", F.col("demand").alias("known_demand"), F.col("supply").alias("known_supply"), F.lit(True).alias("known"))
    return found.join(memo, "id", "left").withColumn("reused", F.coalesce("known", F.lit(False)) & ~F.coalesce(rejected, F.lit(False))).drop("known")


def paging(pages: DataFrame, since: datetime, most_pages: int) -> DataFrame:
    """query, run_id, pages, total_entries, oldest, reached_cutoff, exhausted, capped of each query of a run.

    Pages are taken in order of fetching until one reaches back to ``since`` (the cutoff) or has no
    entries or no new cursor (exhausted), and ``most_pages`` at most (capped).
    """
    # the oldest time of a page's own entries: read off the array in the scan, nothing is unfolded or joined
    times = F.transform(F.filter("timeline.entry", lambda e: e.isNotNull()), lambda e: entry_time(e["createdAt"], e["id"]))
    each = cursors(pages, "fetched_at", F.array_min(times).alias("page_oldest"))
    w = Window.partitionBy("query", "run_id").orderBy("fetched_at", "page_id")
    cut = F.coalesce(F.col("page_oldest") <= F.lit(since).cast("timestamp"), F.lit(False))
    repeated = F.col("next_cursor").eqNullSafe(F.lag("next_cursor").over(w))
    each = each.withColumn("no", F.row_number().over(w)).withColumn("cut", cut).withColumn("out", ~cut & ((F.col("entries") == 0) | F.col("next_cursor").isNull() | repeated))
    ended = F.coalesce(F.max((F.col("cut") | F.col("out")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = each.withColumn("ended", ended).where((F.col("ended") == 0) & (F.col("no") <= most_pages))
    out = taken.groupBy("query", "run_id").agg(F.count("*").alias("pages"), F.sum("entries").alias("total_entries"), F.min("page_oldest").alias("oldest"), F.bool_or("cut").alias("reached_cutoff"), F.bool_or("out").alias("exhausted"))
    return out.withColumn("capped", ~F.col("reached_cutoff") & ~F.col("exhausted") & (F.col("pages") >= most_pages))


def backfill_summary(jobs: DataFrame) -> DataFrame:
    """One row over jobs (reached_cutoff, exhausted, capped, failed, oldest): attempted, succeeded, failed, cutoff, exhausted, capped, oldest, complete."""
    failed = F.coalesce("failed", F.lit(False))
    out = jobs.agg(
        F.count("*").alias("attempted"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.count_if(~failed & F.col("reached_cutoff")).alias("cutoff"),
        F.count_if(~failed & F.col("exhausted")).alias("exhausted"), F.count_if(~failed & F.col("capped")).alias("capped"), F.min(F.when(~failed, F.col("oldest"))).alias("oldest"),
    )
    return out.withColumn("complete", (F.col("failed") == 0) & (F.col("capped") == 0))


def name_queries(cards: DataFrame, aliases: DataFrame, template: str = "ポケポケ %s (求 希望) (譲 出 提供)") -> DataFrame:
    """canonical, search_name, query for each name and each alias of a known name, each once."""
    names = cards.select(F.col("name").alias("canonical"), F.col("name").alias("search_name"))
    other = aliases.select("canonical", F.col("alias").alias("search_name")).join(cards.select(F.col("name").alias("canonical")), "canonical", "left_semi")
    return names.unionByName(other).distinct().withColumn("query", F.format_string(template, "search_name"))


def page_quota(remaining_run: float, remaining_day: float, queries_left: float, most_pages: float) -> int:
    """Pages a query may read: what is left less one for each query after it, one at least; none if any input is none."""
    left, most = (max(0, math.floor(x or 0)) for x in (queries_left, most_pages))
    quota = max(0, math.floor(min(remaining_run or 0, remaining_day or 0)))
    return min(most, max(1, quota - (left - 1))) if left and quota and most else 0


def allocated(quota_run: int, quota_day: int, queries: int, most_pages: int) -> list[int]:
    """Pages of each query in turn when every query uses its quota."""
    out: list[int] = []
    for left in range(queries, 0, -1):
        used = sum(out)
        out.append(page_quota(quota_run - used, quota_day - used, left, most_pages))
    return out


def collected(source: PageSource, queries: Iterable[str], most_pages: int, since_ms: float = -math.inf, times: Callable[[dict], Sequence[float]] = lambda page: [], refuse: bool = False) -> list[dict]:
    """Pages of each query from a source, newest first, until the cutoff, the end or the cap; a refusal ends all queries, or with ``refuse`` is raised.

    ``last`` tells whether a page had no entries or no new cursor.
    """
    out: list[dict] = []
    for query in queries:
        cursor = None
        for _ in range(most_pages):
            try:
                page = fetched(source, query, cursor)
            except AccessBlocked:
                if refuse:
                    raise
                return out
            timeline = page.get("timeline") or {}
            found = timeline.get("entry") or []
            at = list(times(page))
            nxt = (timeline.get("head") or {}).get("oldestTweetId") or (found[-1].get("id") if found else None)
            last = not found or not nxt or str(nxt) == cursor
            out.append({"query": query, "page": page, "last": last})
            if (at and min(at) <= since_ms) or last:
                break
            cursor = str(nxt)
    return out


def backfilled(source: PageSource, jobs: Iterable[tuple[str, int]], since_ms: float = -math.inf, times: Callable[[dict], Sequence[float]] = lambda page: [], wait: Callable[[], None] = lambda: None) -> tuple[list[dict], list[dict]]:
    """Pages of each job (query, most pages) and a row a job: query, pages, total_entries, oldest_ms, reached_cutoff, exhausted, capped, failed, error.

    A job that fails is recorded with its error and what it read is dropped; the next one goes on. Jobs are few and
    fetched one after another, so both lists are the driver's.
    """
    read: list[dict] = []
    jobs_done: list[dict] = []
    for query, most in jobs:
        try:
            found = collected(source, [query], most, since_ms, times, refuse=True)
        except Exception as e:
            jobs_done.append({"query": query, "pages": 0, "total_entries": 0, "oldest_ms": None, "reached_cutoff": False, "exhausted": False, "capped": False, "failed": True, "error": f"{type(e).__name__}: {e}"})
        else:
            read += found
            at = [t for p in found for t in times(p["page"])]
            cut = bool(at) and min(at) <= since_ms
            spent = not cut and found[-1]["last"] if found else False
            entries_of = [len((p["page"].get("timeline") or {}).get("entry") or []) for p in found]
            jobs_done.append({"query": query, "pages": len(found), "total_entries": sum(entries_of), "oldest_ms": min(at, default=None), "reached_cutoff": cut, "exhausted": spent, "capped": not cut and not spent and len(found) >= most, "failed": False, "error": None})
        wait()
    return read, jobs_done
