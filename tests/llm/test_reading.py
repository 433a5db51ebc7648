from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from barterflow.llm import reading

EASY, MIDDLE, HARD = (["cat", "dog", "red", "ball", "run"], ["garden", "window", "answer", "travel"], ["heterogeneous", "endogenous", "asymptotic", "estimator"])


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        level = rng.uniform(-2, 2)
        words = [rng.choice(EASY if x < -0.7 else HARD if x > 0.7 else MIDDLE) if rng.random() < 0.7 else rng.choice(["the", "and", "of"]) for x in (rng.gauss(level, 0.8) for _ in range(60))]
        out.append((i, " ".join(words) + ".", level))
    return out


def test_levels_follow_held_out_levels(spark):
    docs = corpus(500, 1) + [(900, None, 0.0), (901, "", 0.0), (902, "123 🙂", 0.0), (903, "カ" * 50_000, 0.0)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id bigint, text string, level string")
    graded = spark.createDataFrame([(i, float(round(v))) for i, _, v in docs[:250]] + [(251, None), (7000, 1.0)], "doc_id bigint, grade double")
    got = {r.doc_id: r for r in reading.reading_levels(df, graded, "doc_id", "text", "grade").collect()}
    assert set(got) == {i for i, _, _ in docs}
    held = docs[250:500]
    assert np.corrcoef([got[i].level for i, _, _ in held], [v for _, _, v in held])[0, 1] > 0.9
    assert all(np.isfinite(r.level) for r in got.values())
    assert got[900].evidence == 0 and got[901].evidence == 0
    bands = {r.band: r.docs for r in reading.profile(reading.reading_levels(df, graded, "doc_id", "text", "grade")).collect()}
    assert sum(bands.values()) == sum(r.evidence > 0 for r in got.values())


def test_without_grades_and_without_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, grade double")
    assert len({round(r.level, 6) for r in reading.reading_levels(df, none, "doc_id", "text", "grade").collect()}) == 1
    assert reading.reading_levels(df.where("false"), none, "doc_id", "text", "grade").count() == 0


def test_words_do_not_depend_on_slices(monkeypatch):
    texts = ["Ab cd. ef", None, "漢字かな。カナab", "", "x" * 70]
    whole = [(int(p), int(t) + i) for i, _, ps, ts in reading.slices(pa.array(texts)) for p, t in zip(ps, ts)]
    monkeypatch.setattr(reading, "SLICE_BYTES", 4)
    parts = [(int(p), int(t) + i) for i, _, ps, ts in reading.slices(pa.array(texts)) for p, t in zip(ps, ts)]
    assert sorted(whole) == sorted(parts)
    ab = [p for p, t in whole if t == 0][0]
    assert ab in [int(p) for _, _, ps, _ in reading.slices(pa.array(["AB"])) for p in ps]


def test_pair_accuracy_on_held_out_grades(spark):
    """Documents of one language, a grade or more apart, graded but held out."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    grades = spark.read.parquet(f"{d}/reading_grades.parquet").groupBy("doc_id").agg((F.avg("grade") - 3).alias("grade")).where("grade IS NOT NULL")
    train, held = grades.where("doc_id % 4 <> 0"), grades.where("doc_id % 4 = 0")
    rows = reading.reading_levels(docs.join(grades.select("doc_id"), "doc_id"), train, "doc_id", "text", "grade").join(held, "doc_id").join(docs.select("doc_id", F.col("text").rlike(r"\p{IsHiragana}|\p{IsHan}").alias("ja")), "doc_id").collect()
    pairs = [(a.level > b.level) == (a.grade > b.grade) for a in rows for b in rows if a.ja == b.ja and a.grade - b.grade >= 1]
    assert len(pairs) > 500 and np.mean(pairs) > 0.93


def test_planted_levels_and_difficulties_are_recovered(spark):
    """Words of planted difficulty, documents of planted level: a reader of a document's level knows three occurrences in four."""
    rng = np.random.default_rng(4)
    b = np.linspace(-4.5, 2.5, 60)
    names = ["word" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(60)]
    levels = rng.uniform(-2, 2, 600)
    draw = lambda t: rng.choice(60, 80, p=(q := np.exp(-((b - (t - reading.ABOVE)) ** 2) / (2 * 0.6**2))) / q.sum())
    docs = spark.createDataFrame([(i, " ".join(names[k] for k in draw(t))) for i, t in enumerate(levels)], "doc_id bigint, text string")
    graded = spark.createDataFrame([(i, float(levels[i])) for i in range(150)], "doc_id bigint, grade double")
    model, corpus = reading.fitted(docs, graded, "doc_id", "text", "grade")
    places = [int(next(reading.slices(pa.array([n])))[2][0]) for n in names]
    inner = slice(6, 54)  # the outermost words stand in few documents
    assert np.corrcoef(model.b[places][inner], b[inner])[0, 1] > 0.97
    got = {r.doc_id: r.level for r in reading.reading_levels(docs, graded, "doc_id", "text", "grade").collect()}
    held = range(150, 600)
    error = np.array([got[i] - levels[i] for i in held])
    assert np.sqrt((error**2).mean()) < 0.35 and np.corrcoef([got[i] for i in held], levels[150:])[0, 1] > 0.96


def test_levels_solve_their_equation():
    """At a level the weighted share of words known is SHARE."""
    rng = np.random.default_rng(1)
    model = reading.Model(np.zeros(reading.PLACES), np.zeros(reading.PLACES), np.zeros(reading.PLACES))
    model.b[:50], model.weight[:50] = rng.normal(0, 1, 50), rng.uniform(0.1, 3, 50)
    places = [rng.choice(50, 20, replace=False).tolist() for _ in range(30)] + [[], [60]]
    counts = [rng.integers(1, 5, len(p)).tolist() for p in places]
    packed = lambda rows: pa.array([np.array(r, "<i4").tobytes() for r in rows], pa.binary())
    words = reading.Words(packed(places), packed(counts))
    t, w = model.raw_levels(words)
    assert list(w[30:]) == [0, 0]
    for i in range(30):
        p, c = np.array(places[i]), np.array(counts[i])
        x = model.weight[p] * c
        assert abs((x * reading.known(t[i] - model.b[p])).sum() / x.sum() - reading.SHARE) < 2e-3
