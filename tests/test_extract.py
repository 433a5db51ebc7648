from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from barterflow.functions.text import nfkc, strip_highlight
from barterflow.operators import extract

NAMES = ["ナツメ", "カスミ", "カイ", "カキ", "サカキ", "モノマネむすめ", "博士の研究", "アカギ", "ポケモンセンターのお姉さん", "カフェ", "カフェ・ミモレ"]
ALIASES = [("モノマネ娘", "モノマネむすめ"), ("ポケおね", "ポケモンセンターのお姉さん")]


def parsed(spark, body, make=extract.trade_text, names=NAMES):
    rows = spark.createDataFrame([(body,)], "b string")
    c = F.col("b") if make is extract.trade_text else nfkc("b")
    r = rows.select(*make(c, names, ALIASES)).first()
    return sorted(r.demand), sorted(r.supply), r.explicit


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("求：モノマネむすめ、モノマネむすめ、博士の研究 譲：カイ", (["モノマネむすめ", "モノマネむすめ", "博士の研究"], ["カイ"], True)),
        ("求：メガカイリューex、ハラバリー 譲：ナツメ", ([], ["ナツメ"], True)),
        ("出: ポケおね×2 求: モノマネ娘2枚", (["モノマネむすめ"] * 2, ["ポケモンセンターのお姉さん"] * 2, True)),
        ("求: ナツメ", ([], [], False)),
        ("", ([], [], False)),
        (None, ([], [], False)),
        ("求：サカキ 譲）カイ", (["カキ", "サカキ"], ["カイ"], True)),
        ("求:ナツメ×0 カスミ×99 譲:カイ　×　３", (["カスミ"] * 20 + ["ナツメ"], ["カイ"], True)),
        ("求:カフェ・ミモレ 譲:カイ", (["カフェ", "カフェ・ミモレ"], ["カイ"], True)),
        ("求:ナツメ 譲:カイ 求:カスミ", (["カスミ", "ナツメ"], ["カイ"], True)),
    ],
)
def test_trade_text(spark, body, want):
    assert parsed(spark, body) == want


def test_body_digits_are_ascii_only_and_image_text_is_folded(spark):
    assert parsed(spark, "求:ナツメ×２ 譲:カイ")[0] == ["ナツメ"]
    assert parsed(spark, "求 ナツメ×２\n譲 カイ", extract.image_text)[0] == ["ナツメ", "ナツメ"]


def test_one_sided(spark):
    assert parsed(spark, "求\nナツメ", extract.one_sided_text) == (["ナツメ"], [], True)
    assert parsed(spark, "譲\nなし", extract.one_sided_text) == ([], [], False)
    assert parsed(spark, "求 ナツメ\n譲 カイ", extract.one_sided_text) == ([], [], False)
    assert parsed(spark, None, extract.one_sided_text) == ([], [], False)


def test_no_names(spark):
    assert parsed(spark, "求:ナツメ 譲:カイ", names=[]) == ([], [], True)


def by_hand(body: str, names: list[str]) -> dict[str, list[str]]:
    """The rules again, position by position."""
    out: dict[str, list[str]] = {"demand": [], "supply": []}
    marks = list(re.finditer(r"(求む?|希望|譲|出|提供)[ \n　]*[:)]", body))
    if len({m[1][0] in "求希" for m in marks}) < 2:
        return out
    for m, n in zip(marks, [*[x.start() for x in marks[1:]], len(body)]):
        part = body[m.end() : n]
        for at in range(len(part)):
            for name in names:
                rest = part[at + len(name) :]
                if part.startswith(name, at) and not re.match("[ぁ-んァ-ヶー一-龠々]", rest):
                    q = re.match(r"[ \n　]*(?:[×xX＊*][ \n　]*([0-9]+)|([0-9]+)[ \n　]*枚)", rest[:12])
                    k = max(1, min(20, int((q and (q[1] or q[2])) or 1)))
                    out["demand" if m[1][0] in "求希" else "supply"] += [name] * k
    return out


def test_mentions_match_brute_force_on_table_texts(spark):
    from barterflow.sources.files import dictionary
    from barterflow.sources.pages import entries

    d = "/root/testdata/sf0.001"
    names, _ = dictionary(spark.read.parquet(f"{d}/cards.parquet"))
    found = entries(spark.read.parquet(f"{d}/timelines.parquet"))
    body = extract.body_text(strip_highlight("body"))
    for r in found.select(body.alias("body"), *extract.trade_text(strip_highlight("body"), names)).collect():
        want = by_hand(r.body, names)
        assert sorted(r.demand) == sorted(want["demand"]) and sorted(r.supply) == sorted(want["supply"]), r.body
