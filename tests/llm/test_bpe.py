from __future__ import annotations

import random

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from barterflow.llm import bpe

PATH = bpe.vocabulary_path("byte_bpe_50k")
RANKS = bpe.read_ranks(PATH)


def slow_merge(part: bytes) -> list[int]:
    """The definition: merge the leftmost pair of least rank, from single bytes on."""
    tokens = [part[i : i + 1] for i in range(len(part))]
    while len(tokens) > 1:
        ranks = [RANKS.get(a + b, 1 << 60) for a, b in zip(tokens, tokens[1:])]
        best = min(ranks)
        if best == 1 << 60:
            break
        i = ranks.index(best)
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
    return [RANKS[t] for t in tokens]


def slow(text: str | None) -> list[int]:
    return [i for piece in regex.findall(bpe.PATTERN, text or "") for i in slow_merge(piece.encode())]


ENCODER = bpe.Encoder(RANKS)


def fast(texts):
    counts, ids = ENCODER.encode(pa.array(texts, pa.string()))
    out, at = [], 0
    for c in counts:
        out.append(ids[at : at + c].tolist())
        at += c
    return out


def test_segment_tree_merges_like_the_definition():
    rng = random.Random(2)
    for n in [1, 2, 3, 5, 9, 17, 40]:
        for _ in range(40):
            part = bytes(rng.choice(b"aabet \xe3\x81\x82") for _ in range(n))
            assert bpe.merge_part(part, RANKS) == slow_merge(part)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("'st rve\n\t\u3000é漢字かなカナ１2²½👍🏽\u200b"), st.characters(exclude_categories=["Cs"])), max_size=30)), max_size=6))
def test_any_text(texts):
    assert fast(texts) == [slow(t) for t in texts]


def test_hard_texts():
    texts = [None, "", " ", "  ", "a", "it's 'tis  's\n's we'll'll", "''s", "x'st", " 're", "a" * 3000, "\n" * 50, "あ" * 500, "a\r\n\r\n b", "'", "don't", "🙂🙂 text", "\x00\x00 \x00"]
    assert fast(texts) == [slow(t) for t in texts]


def test_library_agrees_on_table_texts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(docs, "doc_id", "text", PATH).collect()}
    assert got == {k: own.encode_ordinary(t or "") for k, t in texts.items()}
    back = {k: own.decode(v) for k, v in got.items()}
    assert back == {k: t or "" for k, t in texts.items()}
    sizes = {r.doc_id: r.tokens for r in bpe.token_counts(docs, "doc_id", "text", PATH).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}


def test_small_memory_and_slices(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 10)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 16)
    ENCODER.forget()
    texts = ["one two three four five six", None, "漢字とかなの文。", "", "extraordinarily internationalisation 12345678"] * 5
    assert fast(texts) == [slow(t) for t in texts]
    sliced = pa.array(["skip", *texts], pa.string())[1:]
    assert bpe.Encoder(RANKS).encode(sliced)[0].tolist() == [len(slow(t)) for t in texts]


def test_empty_table_and_unknown_vocabulary(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, ids string")
    assert bpe.encode_corpus(df, "doc_id", "text", PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.vocabulary_path("none")


def test_decoded_again(spark):
    texts = [None, "", "カード 2枚 🙂\r\n", "a" * 3000, "don't", "\u0000\uffff", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(df, "doc_id", "text", PATH), "doc_id", PATH).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.decode_corpus(bpe.encode_corpus(df.where("false"), "doc_id", "text", PATH), "doc_id", PATH).count() == 0


def test_remembered_parts_grow():
    """Parts learned batch after batch are found again, in either sorted part."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    one = bpe.Encoder(RANKS)
    for lo in (*range(0, 3000, 100), *range(0, 3000, 700)):
        part = words[lo : lo + 100]
        counts, ids = one.encode(pa.array(part, pa.string()))
        assert ids.tolist() == [i for t in part for i in slow(t)]
    assert len(one.fresh) < len(one.keys)
