"""Strings within a number of edits of a reference string, without comparing all with all. SQL only.

A reference string of ``len`` characters that allows ``k`` edits is cut into k+1 parts (at most
``len``): whatever the edits, a value within them holds one part unchanged, and near where it stood.
Part i (from 0) can be preceded by at most i edits and followed by at most k-i, or an earlier or
later part is unchanged too; with a value d characters longer it stands between max(-i, d-k+i) and
min(i, d+k-i) places on. Values and references meet by equality on (length, part number, substring);
the built-in levenshtein with its threshold verifies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """``text`` with each {name} standing for a DataFrame; braces of patterns stay as they are."""
    views = {name: f"v_{uuid.uuid4().hex}" for name in frames}
    for name, view in views.items():
        frames[name].createOrReplaceTempView(view)
        text = text.replace("{" + name + "}", view)
    out = spark.sql(text)
    for view in views.values():
        spark.catalog.dropTempView(view)
    return out


def edits_sql(edits: list[tuple[int | None, int]]) -> str:
    """Edits by length, [(up to this length, edits), ..., (None, edits)], as an expression over ``len``."""
    *shorter, (_, k) = edits
    return "CASE " + " ".join(f"WHEN len <= {most} THEN {n}" for most, n in shorter) + f" ELSE {k} END" if shorter else str(k)


def within_edits(values: DataFrame, refs: DataFrame, edits: list[tuple[int | None, int]]) -> DataFrame:
    """value, ref, distance of every value (column value) and reference string (column ref), each once, within the edits the reference's length allows.

    Null and empty strings meet nothing. Two strings both as short as the edits allowed are within
    them whatever they hold: they meet by length, and each such pair is in the result.
    """
    k, most = edits_sql(edits), max(n for _, n in edits)
    known = query(values.sparkSession, f"SELECT ref, len, k, least(k + 1, len) AS parts FROM (SELECT ref, len, {k} AS k FROM (SELECT ref, length(ref) AS len FROM {{refs}}) WHERE len > 0)", refs=refs)
    return query(
        values.sparkSession,
        f"""
        WITH cut AS (
          SELECT ref, len, k, i, substring(ref, (len * i) DIV parts + 1, (len * (i + 1)) DIV parts - (len * i) DIV parts) AS part
          FROM {{known}} LATERAL VIEW explode(sequence(0, parts - 1)) AS i
          UNION ALL SELECT ref, len, k, -1, '' FROM {{known}} WHERE len <= k
        ), lens AS (SELECT collect_set(named_struct('len', len, 'k', k, 'parts', parts)) AS lens FROM {{known}}),
        fits AS (SELECT value, own, f.len, f.k, f.parts FROM (SELECT value, length(value) AS own, (SELECT lens FROM lens) AS lens FROM {{values}} WHERE value <> '')
          LATERAL VIEW explode(filter(lens, x -> abs(x.len - own) <= x.k)) AS f),
        probes AS (
          SELECT value, len, p.i, p.part FROM fits LATERAL VIEW explode(flatten(transform(sequence(0, parts - 1), i ->
            transform(filter(sequence(if(parts <= k, -k, greatest(-i, own - len - k + i)), if(parts <= k, k, least(i, own - len + k - i))),
              by -> (len * i) DIV parts + by >= 0 AND (len * (i + 1)) DIV parts + by <= own AND (parts <= k OR by BETWEEN greatest(-i, own - len - k + i) AND least(i, own - len + k - i))),
              by -> named_struct('i', i, 'part', substring(value, (len * i) DIV parts + 1 + by, (len * (i + 1)) DIV parts - (len * i) DIV parts)))))) AS p
          UNION ALL SELECT value, len, -1, '' FROM fits WHERE len <= k AND own <= k
        ), met AS (SELECT DISTINCT p.value, c.ref, c.k FROM probes p JOIN cut c ON p.len = c.len AND p.i = c.i AND p.part = c.part)
        SELECT value, ref, distance FROM (SELECT value, ref, levenshtein(value, ref, k) AS distance FROM met) WHERE distance >= 0
        """,
        values=values,
        known=known,
    )
