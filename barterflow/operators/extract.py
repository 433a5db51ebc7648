"""Wanted and offered names out of free text.

A text is cut at its headings into segments; in each segment the names of a dictionary are
found by one pattern that looks ahead from every position, so that names inside other names
count too, as do their quantities.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barterflow.functions.text import NAME_CHARS, SPACE, canonical_aliases, clean_text, col, ocr_text, quoted

#: Headings of a body (a sign must follow) and of a text read from an image (it may be missing), the first ones wanting.
BODY_MARK = rf"(求む?|希望|譲|出|提供)[{SPACE}]*[:)]"
IMAGE_MARK = rf"(?m)(欲しいカード|ほしいカード|求めるカード|希望カード|求む|求|希望|出せるカード|譲れるカード|提供カード|譲|出|提供)[{SPACE}]*(?::|\)|）|】|\]|$)?"
WANTING = "^(欲しい|ほしい|求|希望)"
MOST_COPIES, TAIL = 20, 12


def name_layers(names: Sequence[str]) -> list[list[str]]:
    """The names in groups in which none begins with another: at one position a group has at most one match."""
    layers: list[list[str]] = []
    for name in sorted({n for n in names if n}, key=lambda n: (len(n), n)):
        for layer in layers:
            if not any(name.startswith(x) for x in layer):
                layer.append(name)
                break
        else:
            layers.append([name])
    return layers


def copies(tail: Column) -> Column:
    """The quantity a name's tail begins with, from 1 to 20; 1 where there is none."""
    # three digits after the zeros tell whether it is above the most that count
    pattern = rf"\A[{SPACE}]*(?:[×xX＊*][{SPACE}]*(?=[0-9])|(?=[0-9]+[{SPACE}]*枚))0*([0-9]{{0,3}})"
    n = F.coalesce(F.regexp_extract(tail, pattern, 1).try_cast("int"), F.lit(1))
    return F.greatest(F.lit(1), F.least(F.lit(MOST_COPIES), n))


def _read_off(name: str) -> Callable[[Column], Column]:
    """A match as its name and itself, so that the name is looked for once."""
    return lambda m: F.struct(F.regexp_extract(m, rf"\A{name}", 0).alias("name"), m.alias("match"))


def _counted(x: Column) -> Column:
    return F.struct(x["name"].alias("name"), copies(F.substring(x["match"], F.length(x["name"]) + 1, F.length(x["match"]))).alias("n"))


def mentions(segment: Column | str, names: Sequence[str], aliases: Sequence[tuple[str, str]] = ()) -> Column:
    """array<struct<name, n>> of the names in a segment with their quantities, in order of position by group; empty for null and for no names.

    A name counts where no kana or kanji follows it; it may stand inside a longer word, and inside another name.
    """
    text = canonical_aliases(F.coalesce(col(segment), F.lit("")), aliases)
    found = []
    for layer in name_layers(names):
        # one pass: each match with its tail; the name is then read off the short match
        begins = "".join(sorted({re.sub(r"([\\\]\[^&-])", r"\\\1", n[0]) for n in layer}))
        names_of = rf"(?:{quoted(layer)})(?![{NAME_CHARS}])"
        matches = F.regexp_extract_all(text, F.lit(rf"(?=[{begins}])(?=({names_of}[\s\S]{{0,{TAIL}}}))"), 1)
        found.append(F.transform(F.transform(matches, _read_off(names_of)), _counted))
    if not found:
        return F.array().cast("array<struct<name:string,n:int>>")
    return F.concat(*found)


def segments(text: Column | str, mark: str) -> Column:
    """array<struct<kind, text>>: from each heading to the next; kind is demand or supply. What precedes the first heading is dropped."""
    flag = "(?m)" if mark.startswith("(?m)") else ""
    bare = mark.removeprefix("(?m)")
    cut = F.filter(F.split(col(text), f"{flag}(?={bare})"), lambda s: s.rlike(rf"{flag}\A{bare}"))
    kind = lambda s: F.when(s.rlike(WANTING), "demand").otherwise("supply")
    return F.transform(cut, lambda s: F.struct(kind(s).alias("kind"), F.regexp_replace(s, rf"{flag}\A{bare}", "").alias("text")))


def expanded(pairs: Column) -> Column:
    """array<string> with n copies of each name."""
    return F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["name"], p["n"])))


def _side(parts: Column, kind: str, names: Sequence[str], aliases: Sequence[tuple[str, str]]) -> Column:
    return expanded(F.flatten(F.transform(F.filter(parts, lambda s: s["kind"] == kind), lambda s: mentions(s["text"], names, aliases))))


def _parsed(parts: Column, use: Column, names: Sequence[str], aliases: Sequence[tuple[str, str]]) -> list[Column]:
    none = F.array().cast("array<string>")
    return [F.coalesce(F.when(use, _side(parts, k, names, aliases)), none).alias(k) for k in ("demand", "supply")]


def _kinds(parts: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(F.transform(parts, lambda s: s["kind"]))), F.lit(0))


def body_text(c: Column | str) -> Column:
    return F.translate(clean_text(c), "：﹕）", "::)")


def trade_text(body: Column | str, names: Sequence[str], aliases: Sequence[tuple[str, str]] = ()) -> list[Column]:
    """demand, supply, explicit of a body: both sides need a heading, else nothing is taken from it."""
    return two_sided(segments(body_text(body), BODY_MARK), names, aliases)


def two_sided(parts: Column, names: Sequence[str], aliases: Sequence[tuple[str, str]] = ()) -> list[Column]:
    """demand, supply, explicit of the segments of a text."""
    both = _kinds(parts) == 2
    return [*_parsed(parts, both, names, aliases), F.coalesce(both, F.lit(False)).alias("explicit")]


def image_text(plain: Column | str, names: Sequence[str], aliases: Sequence[tuple[str, str]] = ()) -> list[Column]:
    """demand, supply, explicit of a text read from an image (already NFKC): more headings, with or without a sign after them."""
    return two_sided(segments(ocr_text(plain), IMAGE_MARK), names, aliases)


def one_sided_text(plain: Column | str, names: Sequence[str], aliases: Sequence[tuple[str, str]] = ()) -> list[Column]:
    """demand, supply, explicit of a text read from an image with headings of one kind only; explicit where a name was found."""
    parts = segments(ocr_text(plain), IMAGE_MARK)
    demand, supply = _parsed(parts, _kinds(parts) == 1, names, aliases)
    return [demand, supply, ((F.size(demand) > 0) | (F.size(supply) > 0)).alias("explicit")]


def sheet_segments(plain: Column | str) -> Column:
    """The segments of a text read from an image (already NFKC)."""
    return segments(ocr_text(plain), IMAGE_MARK)


def any_sided(parts: Column, names: Sequence[str], aliases: Sequence[tuple[str, str]] = ()) -> list[Column]:
    """demand, supply, explicit of segments with headings of both kinds or of one; explicit where a name was found."""
    demand, supply = _parsed(parts, _kinds(parts) > 0, names, aliases)
    return [demand, supply, ((F.size(demand) > 0) | (F.size(supply) > 0)).alias("explicit")]
