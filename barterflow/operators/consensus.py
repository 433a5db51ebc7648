"""Decisions over several readings of one image: fuzzy titles, votes, badges, image against text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barterflow.functions.text import digits, nfkc, title_text, title_tokens
from barterflow.operators.pigeonhole import within_edits

#: Thresholds by length of the title: gap and edits allowed from LONG on and below, least score from a length on.
LONG, LEAST_SCORES, AMBIGUOUS = 10, ((10, 0.86), (6, 0.88), (0, 0.80)), 0.08


def title_variants(cards: DataFrame, aliases: DataFrame) -> DataFrame:
    """normalized, canonical: the names (column name) and the aliases (alias, canonical) of known names, as titles."""
    known = cards.select(F.col("name").alias("raw"), F.col("name").alias("canonical")).unionByName(aliases.select(F.col("alias").alias("raw"), "canonical").join(cards.select(F.col("name").alias("canonical")), "canonical", "left_semi"))
    return known.select(title_text(nfkc("raw")).alias("normalized"), "canonical").where("normalized <> ''").distinct()


def title_matches(passes: DataFrame, variants: DataFrame) -> DataFrame:
    """cell_id, pass, canonical, exact, distance, score, confidence: the best title of each reading; no row where none fits or two fit alike.

    ``passes``: cell_id, pass, text, confidence. Equal titles meet by equality; the rest by a part they share unchanged,
    before any distance is computed, each distinct token once.
    """
    read = passes.select("cell_id", "pass", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.explode(title_tokens(nfkc("text"))).alias("token")).where(F.length("token") >= 2)
    tokens = read.select("token").distinct()
    v = variants.select("normalized", "canonical", F.length("normalized").alias("len"))
    exact = tokens.join(v, tokens.token == v.normalized).select("token", "canonical", "len", F.lit(True).alias("exact"), F.lit(0).alias("distance"), F.lit(1.0).alias("score"))
    # titles of up to three characters allow no edit
    met = within_edits(tokens.select(F.col("token").alias("value")), v.where("len > 3").select(F.col("normalized").alias("ref")).distinct(), [(LONG - 1, 1), (None, 2)])
    fuzzy = met.where("distance > 0").join(v, F.col("ref") == F.col("normalized")).select(F.col("value").alias("token"), "canonical", "len", "distance")
    fuzzy = fuzzy.withColumn("score", 1 - F.col("distance") / F.greatest(F.length("token"), "len"))
    least = F.when(F.col("len") >= LEAST_SCORES[0][0], LEAST_SCORES[0][1]).when(F.col("len") >= LEAST_SCORES[1][0], LEAST_SCORES[1][1]).otherwise(LEAST_SCORES[2][1])
    fuzzy = fuzzy.where(F.col("score") >= least).select("token", "canonical", "len", F.lit(False).alias("exact"), "distance", "score")
    met = read.join(exact.unionByName(fuzzy), "token")
    rank = F.struct((~F.col("exact")).alias("a"), F.col("distance").alias("b"), (-F.col("score")).alias("c"), (-F.col("confidence")).alias("d"), (-F.col("len")).alias("e"), F.col("canonical").alias("f"))
    of = met.groupBy("cell_id", "pass", "canonical").agg(F.min_by(F.struct("exact", "distance", "score", "confidence"), rank).alias("m"), F.min(rank).alias("r"))
    w = Window.partitionBy("cell_id", "pass").orderBy("r")
    ranked = of.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("m").over(w)).where("n = 1")
    alike = (F.col("m.exact") == F.col("next.exact")) & (F.col("m.distance") == F.col("next.distance")) & (F.abs(F.col("m.score") - F.col("next.score")) < AMBIGUOUS)
    return ranked.where(~F.coalesce(alike, F.lit(False))).select("cell_id", "pass", "canonical", "m.*")


def voted(matches: DataFrame) -> DataFrame:
    """cell_id, canonical, votes, exact_votes, avg_score, avg_confidence (to twelve decimals, whatever the order of adding up), best_distance."""
    return matches.groupBy("cell_id", "canonical").agg(
        F.count("*").alias("votes"), F.count_if("exact").alias("exact_votes"), F.round(F.avg("score"), 12).alias("avg_score"), F.round(F.avg("confidence"), 12).alias("avg_confidence"), F.min("distance").alias("best_distance")
    )


def consensus(votes: DataFrame) -> DataFrame:
    """cell_id, canonical of the cells whose readings agree well enough; no row for the others.

    Exact titles need two votes, short ones (up to three characters) three, and a rival with two fewer at
    most; fuzzy titles need three votes, or four two edits away, and no rival as strong.
    """
    order = [F.desc("exact_votes"), F.desc("votes"), F.desc("avg_score"), F.desc("avg_confidence"), F.asc("best_distance"), F.collate("canonical", "ja"), F.col("canonical")]
    w = Window.partitionBy("cell_id").orderBy(*order)
    best = votes.withColumn("n", F.row_number().over(w)).withColumn("rival", F.lead(F.struct("votes", "exact_votes", "avg_score")).over(w)).where("n = 1")
    short = F.length(title_text("canonical")) <= 3
    rival_exact, rival_votes = F.coalesce("rival.exact_votes", F.lit(0)), F.coalesce("rival.votes", F.lit(0))
    by_title = (F.col("exact_votes") >= F.when(short, 3).otherwise(2)) & ~((rival_exact > 0) & (rival_exact >= F.col("exact_votes") - 1))
    close = (rival_votes == F.col("votes") - 1) & (F.abs(F.col("avg_score") - F.col("rival.avg_score")) < AMBIGUOUS)
    by_edits = (F.col("votes") >= F.when(F.col("best_distance") >= 2, 4).otherwise(3)) & (rival_votes < F.col("votes")) & ~F.coalesce(close, F.lit(False))
    return best.where(F.when(F.col("exact_votes") > 0, by_title).otherwise(by_edits)).select("cell_id", "canonical")


def badges(readings: DataFrame, metrics: DataFrame, rank: str = "2", others: str = "[13]", dark: float = 0.18, yellow: float = 0.0025) -> DataFrame:
    """cell_id, verified: whether a cell's badge shows ``rank``. ``readings``: cell_id, text; ``metrics``: cell_id, dark_ratio, yellow_ratio (missing: 0).

    From five readings on three votes with a margin of two are needed, below two with a margin of one.
    """
    seen = digits(nfkc("text"))
    won = seen.contains(rank)
    counted = readings.groupBy("cell_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(won, F.lit(False))).alias("yes"), F.count_if(F.coalesce(~won & seen.rlike(others), F.lit(False))).alias("no"))
    both = metrics.join(counted, "cell_id", "left").na.fill(0, ["n", "yes", "no", "dark_ratio", "yellow_ratio"])
    enough = F.when(F.col("n") >= 5, (F.col("yes") >= 3) & (F.col("yes") - F.col("no") >= 2)).otherwise((F.col("yes") >= 2) & (F.col("yes") - F.col("no") >= 1))
    return both.select("cell_id", ((F.col("dark_ratio") >= dark) & (F.col("yellow_ratio") >= yellow) & enough).alias("verified"))


def visual_gate(title_entropy: Column, title_sd: Column, body_entropy: Column, body_sd: Column) -> Column:
    """Whether a cell of an image shows anything worth reading."""
    return ((title_entropy >= 2.2) & (title_sd >= 10)) | ((body_entropy >= 3.2) & (body_sd >= 18))


def visual_decision(ocr: Column, best: Column, best_score: Column, second_score: Column, strong: float = 0.92, agree: float = 0.80, margin: float = 0.035, strong_margin: float = 0.055) -> list[Column]:
    """card, reason of a cell: the image's best match against the title read; they must not contradict each other."""
    lead = best_score - F.coalesce(second_score, F.lit(0.0))
    read = F.nullif(ocr, F.lit(""))
    reason = (
        F.when(best.isNull() | (best == ""), "no-image-match")
        .when(read.isNotNull() & (read != best), "image-ocr-conflict")
        .when(read.isNull() & (best_score >= strong) & (lead >= strong_margin), "image-strong")
        .when((read == best) & (best_score >= agree) & (lead >= margin), "image+ocr")
        .otherwise("image-not-confident")
    )
    return [F.when(reason.isin("image-strong", "image+ocr"), best).alias("card"), reason.alias("reason")]


def runs(rows: DataFrame, group: str, at: str, score: str, least_score: float = 0.40, least_rows: int = 5) -> DataFrame:
    """group, start, end, score (mean) of each stretch of neighbouring rows at or above the least score, long enough (gaps and islands)."""
    hit = rows.where(F.col(score) >= least_score)
    island = hit.withColumn("__i", F.col(at) - F.row_number().over(Window.partitionBy(group).orderBy(at)))
    out = island.groupBy(group, "__i").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.avg(score).alias("score"), F.count("*").alias("__n"))
    return out.where(F.col("__n") >= least_rows).select(group, "start", "end", "score")

