"""Catalogues compared: what is missing, extra, unknown, configured twice; references of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def selected_prints(prints: DataFrame, kind: str, subtype: str, rarity: str) -> DataFrame:
    """Prints of one kind with a name that isn't blank, their name trimmed."""
    return prints.where((F.col("type") == kind) & (F.col("subtype") == subtype) & (F.col("rarity") == rarity) & (F.trim("name") != "")).withColumn("name", F.trim("name"))


def first_prints(prints: DataFrame, order: str) -> DataFrame:
    """name, first_id, first_set, prints of each name, by the print first in ``order``."""
    return prints.groupBy("name").agg(F.min_by("id", order).alias("first_id"), F.min_by("set_code", order).alias("first_set"), F.count("*").alias("prints"))


def audited(names: DataFrame, configured: DataFrame, name_map: DataFrame) -> DataFrame:
    """finding, name: 'unknown' (no translation), 'missing' (not configured), 'extra' (configured, not in the catalogue), 'duplicate' (configured twice).

    ``names``: column name; ``configured``: column name, repeats allowed; ``name_map``: en, ja. Anti-joins both ways; no row: nothing to report.
    """
    translated = names.select("name").distinct().join(name_map.select(F.col("en").alias("name"), "ja").where("ja IS NOT NULL").dropDuplicates(["name"]), "name", "left")
    expected = translated.where("ja IS NOT NULL").select(F.col("ja").alias("name")).distinct()
    parts = {
        "unknown": translated.where("ja IS NULL").select("name"),
        "missing": expected.join(configured.select("name"), "name", "left_anti"),
        "extra": configured.select("name").distinct().join(expected, "name", "left_anti"),
        "duplicate": configured.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"),
    }
    out = None
    for finding, rows in parts.items():
        rows = rows.select(F.lit(finding).alias("finding"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def references(prints: DataFrame, name_map: DataFrame, allowed: DataFrame, kind: str, subtype: str, rarity: str) -> DataFrame:
    """id, english_name, canonical, image of the prints that translate to an allowed name and have an image."""
    image = F.coalesce(F.nullif("image_png", F.lit("")), F.nullif("image", F.lit("")))
    of_kind = prints.where((F.col("type") == kind) & (F.col("subtype") == subtype) & (F.col("rarity") == rarity)).withColumn("__image", image).where("__image IS NOT NULL")
    named = of_kind.join(name_map.select(F.col("en").alias("name"), F.col("ja").alias("canonical")).dropDuplicates(["name"]), "name")
    return named.join(allowed.select(F.col("name").alias("canonical")).distinct(), "canonical", "left_semi").select(F.col("id").cast("string").alias("id"), F.col("name").alias("english_name"), "canonical", F.col("__image").alias("image"))


def refresh_accepted(found: int, cards: int) -> bool:
    """Whether a refreshed reference set is whole enough to replace the old one."""
    return found >= max(20, int(cards * 0.65))


def sane(cards: int, names: int, least_cards: int = 1000, least_names: int = 75) -> bool:
    """Whether a fetched catalogue is large enough to be compared with."""
    return cards >= least_cards and names >= least_names


def report(findings: DataFrame) -> str:
    """The findings as a short text; a catalogue's findings are few."""
    rows = findings.groupBy("finding").agg(F.sort_array(F.collect_set("name")).alias("names")).collect()
    by = {r.finding: r.names for r in rows}
    return "\n".join(f"- {k}: {', '.join(by[k]) if by.get(k) else 'none'}" for k in ("unknown", "missing", "extra", "duplicate"))


def carried_over(wanted: DataFrame, old: DataFrame) -> DataFrame:
    """Wanted references (id, image and more) with the fingerprint (gray, color) an older set has for the same id and image; null where it must be made."""
    known = old.where("gray IS NOT NULL AND color IS NOT NULL").select("id", "image", "gray", "color").dropDuplicates(["id", "image"])
    return wanted.drop("gray", "color").join(known, ["id", "image"], "left")
