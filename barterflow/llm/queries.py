"""Queries of the problems of training data, by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barterflow.llm import bpe, canonlist, lookalike, packing, queries_sql, reading, stripes
from barterflow.llm.readings import READINGS
from barterflow.plans.posts import card_names, kept_posts, mentions, table
from barterflow.shared import materialised

#: The 5 % point of the chi-squared distribution with one degree of freedom.
SIGNIFICANT = 3.841
#: Names up to which the dictionary is sent to every task; a larger one meets the counts of all names instead.
VOCABULARY = 100_000


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of cards of a kept post, with counts, lift and log-likelihood ratio."""
    cards = card_names(spark, sf_dir)
    known = [r.name for r in cards.limit(VOCABULARY + 1).collect()]
    kept = kept_posts(table(spark, sf_dir, "posts"), [F.array_distinct(mentions()).alias("names")])
    if len(known) <= VOCABULARY:
        out = stripes.cooccurrence(kept, "names", known)
    else:
        out = stripes.cooccurrence(kept, "names")
        for side in ("name_a", "name_b"):
            out = out.join(cards.withColumnRenamed("name", side), side, "left_semi")
    return out.select("name_a", "name_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, n_a, n_b, n_ab = (F.col(c) for c in ("n", "n_a", "n_b", "n_ab"))
    case = (n_ab >= 6) & (n_ab * 1000 >= n) & (n_ab * n >= n_a * 3 * n_b)  # 6 together at three times chance is significant
    return p1_pairs(spark, sf_dir).where(case & (F.col("llr") >= SIGNIFICANT)).select("name_a", "name_b")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, id, body of every entry of every page."""
    pages = table(spark, sf_dir, "timelines").select("page_id", F.explode("timeline.entry").alias("e"))
    return pages.select("page_id", F.col("e.id").alias("id"), F.col("e.displayTextBody").alias("body"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_pairs(entries(spark, sf_dir), "id", "body", lookalike.looks(spark))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class of bodies that look alike and are stored in several ways, with its representative and counts."""
    return lookalike.look_classes(entries(spark, sf_dir), "id", "body", lookalike.looks(spark)).drop("form")


def p2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed and whole-script tokens of all bodies."""
    return lookalike.confused_tokens(entries(spark, sf_dir), "body", lookalike.looks(spark))


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its body in the consistent form."""
    return lookalike.with_consistent(entries(spark, sf_dir), "body", "form", lookalike.looks(spark)).drop("body")


def word_readings(spark: SparkSession) -> DataFrame:
    """word, reading: how the kanji words of the card names are read; it comes with the list, as aliases do."""
    return spark.createDataFrame([tuple(w.split("=")) for w in READINGS], "word string, reading string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonlist.named_otherwise(entries(spark, sf_dir), table(spark, sf_dir, "cards"), word_readings(spark))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed value (by its key) with the card it means; null: none."""
    return canonlist.mapped_values(canonlist.plain_bodies(entries(spark, sf_dir)), table(spark, sf_dir, "cards"), word_readings(spark))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", bpe.vocabulary_path("byte_bpe_50k"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each document's ids, which is its text."""
    return bpe.decode_corpus(p6_ids(spark, sf_dir), "doc_id", bpe.vocabulary_path("byte_bpe_50k"))


def _filled(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """Fillings, sizes and kinds of containers of each tokenizer."""
    docs, kinds = table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers")
    out = []
    for (name,) in kinds.where("tokenizer IS NOT NULL").select("tokenizer").distinct().orderBy("tokenizer").collect():
        sizes = materialised(bpe.token_counts(docs, "doc_id", "text", bpe.vocabulary_path(name)), "sizes")
        own = kinds.where(F.col("tokenizer") == name)
        out.append((packing.packed(sizes, own), sizes, own))
    if not out:  # no kind of container names a tokenizer: nothing to fill
        sizes, own = docs.select("doc_id", F.lit(0).cast("bigint").alias("tokens")).where("false"), kinds.where("false")
        out.append((packing.packed(sizes, own), sizes, own))
    return out


def p7_fillings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container, for each kind of container."""
    return reduce(DataFrame.unionByName, [filled for filled, _, _ in _filled(spark, sf_dir)])


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every token of every document is in one container of each kind and no container holds too much."""
    return reduce(DataFrame.unionByName, [packing.audited(*x) for x in _filled(spark, sf_dir)])


def p7_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the fewest possible, and the share of room filled, by kind."""
    return packing.waste(p7_fillings(spark, sf_dir), table(spark, sf_dir, "containers"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, level, evidence of every document; grades by several raters are averaged."""
    grades = table(spark, sf_dir, "reading_grades").groupBy("doc_id").agg((F.avg("grade") - 3).alias("grade"))
    return reading.reading_levels(table(spark, sf_dir, "documents"), grades, "doc_id", "text", "grade")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "reading_pairs").where("pair_id IS NOT NULL")
    both = pairs.select("pair_id", F.explode(F.array("doc_a", "doc_b")).alias("doc_id"))
    levels = p8_levels(spark, sf_dir).join(both, "doc_id")
    return levels.groupBy("pair_id").agg(F.max_by("doc_id", F.struct("level", "doc_id")).alias("doc_id"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by band of the reading level."""
    return reading.profile(p8_levels(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_texts": p2_texts, "p2_classes": p2_classes, "p2_tokens": p2_tokens, "p5_found": p5_found, "p5_values": p5_values, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_fillings": p7_fillings, "p7_audit": p7_audit, "p7_waste": p7_waste, "p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile}

ORACLES = queries_sql.ORACLES
