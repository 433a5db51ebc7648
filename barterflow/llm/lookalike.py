"""One form for text that looks the same but is stored in other characters (problem 2).

Each token (a run of letters) is cut where it passes between Japanese and other scripts, and
each part gets the set of scripts every one of its characters could be read in; look-alike
letters belong to several, kanji and kana also to the joint set Japanese. The scripts that all
characters share decide the spelling; a part of look-alikes only is a whole-script confusable
and takes the preferred script; a part without a shared script is mixed, and there each
look-alike takes the script of the nearest character that leaves no doubt. Inside Japanese,
where scripts do change in a word, a look-alike takes the script its neighbours speak for, so
that what was written well stays as it is. The spelling depends on the look alone. Width,
blanks, invisible characters and the order of marks are normalised before. Case, accents,
voicing marks and small kana stay.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barterflow.shared import materialised

LATIN, GREEK, CYRILLIC, KATAKANA, HIRAGANA, HAN = "Latin", "Greek", "Cyrillic", "Katakana", "Hiragana", "Han"
#: The joint set of the scripts Japanese is written in, and scripts whose letters may look like others'.
JAPANESE, OTHERS = "Japanese", ("Armenian", "Cherokee", "Coptic", "Lisu")

#: Letters that look alike, a row a shape, a column a script.
SHAPES = (LATIN, GREEK, CYRILLIC), """
AΑА BΒВ C-С EΕЕ HΗН IΙІ J-Ј KΚК MΜМ NΝ- OΟО PΡР S-Ѕ TΤТ XΧХ YΥ- ZΖ- a-а c-с e-е i-і j-ј oοо p-р s-ѕ vν- x-х y-у
""".split()  # fmt: skip
KANA_SHAPES = (KATAKANA, HIRAGANA, HAN), """
カ-力 ロ-口 ニ-二 エ-工 タ-夕 ト-卜 ハ-八 ー-一 ヘへ- リり- ベべ- ペぺ-
""".split()  # fmt: skip

#: Signs that look alike; the first of a row stands for all.
SIGNS = """
-‐‑‒–−
:꞉ː∶
/∕⁄
*∗
・·‧∙⋅
~〜∼
""".split()

#: Spellings in order of preference where nothing decides.
PREFERRED = (LATIN, CYRILLIC, GREEK, *OTHERS, KATAKANA, HIRAGANA, HAN)
JOINT = (KATAKANA, HIRAGANA, HAN)

#: Decompositions that change width or an equal-looking variant only; circles, superscripts, squares and fractions look different.
SAME_LOOK = ("<wide>", "<narrow>", "<small>", "<noBreak>")


def _forms() -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    shapes: dict[str, dict[str, str]] = {}
    for scripts, rows in (SHAPES, KANA_SHAPES):
        for row in rows:
            shape = {s: c for s, c in zip(scripts, row, strict=True) if c != "-"}
            shapes |= dict.fromkeys(shape.values(), shape)
    signs = {c: row[0] for row in SIGNS for c in row[1:]}
    return shapes, signs


FORMS, SIGN_OF = _forms()

_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_CONTROL = regex.compile(r"[\t\r\v\f\x1c-\x1f]")
_BLANK = regex.compile(r"[^\S\n\r]")
_UNSEEN = regex.compile(r"(?<=[\p{So}\p{Sk}\ufe0f])\u200d(?=\p{So})(*SKIP)(*FAIL)|[\p{Cf}\u034f\u180b-\u180d]|(?<![\p{So}\p{Sm}\p{N}#*])[\ufe0e\ufe0f]")


@lru_cache(1 << 16)
def _script(c: str) -> str:
    if regex.match(r"\p{Han}", c):
        return HAN
    for s in PREFERRED[:-1]:
        if regex.match(rf"\p{{{s}}}", c):
            return s
    return ""


@lru_cache(1 << 16)
def _width(c: str) -> str:
    """The plain form of a character that differs from it in width or make only."""
    d = unicodedata.decomposition(c)
    if d.startswith(SAME_LOOK) or (d.startswith("<compat>") and (0x2E80 <= ord(c) <= 0x2FDF or 0xFB00 <= ord(c) <= 0xFB06 or 0x2160 <= ord(c) <= 0x217F)):
        return unicodedata.normalize("NFKC", c)
    return c


def looks(spark: SparkSession) -> dict[str, dict[str, str]]:
    """FORMS and what Unicode's table of confusables adds to it, as the Unicode library that comes with Spark has it.

    Added are single letters of the scripts written here without kana and kanji, of one general category (so case is kept)
    and one prototype. Where a script has several letters of one prototype, that of FORMS or else the prototype itself stays:
    letters of one script aren't taken for each other. A few hundred letters, whatever the corpus.
    """
    letters = [chr(c) for c in range(0x41, 0x10000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and _script(chr(c)) in (*PREFERRED[:3], *OTHERS) and _width(chr(c)) == chr(c) and not unicodedata.decomposition(chr(c))]
    prototypes = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    of: dict[tuple[str, str], dict[str, list[str]]] = {}
    for c, p in zip(letters, prototypes, strict=True):
        if len(p) == 1:
            of.setdefault((p, unicodedata.category(c)), {}).setdefault(_script(c), []).append(c)
    out = dict(FORMS)
    for (p, _), scripts in of.items():
        known = next((FORMS[c] for cs in scripts.values() for c in cs if c in FORMS), {})
        shape = known | {s: cs[0] if len(cs) == 1 else p for s, cs in scripts.items() if s not in known and (len(cs) == 1 or p in cs)}
        if len(shape) > 1:
            out |= dict.fromkeys(shape.values(), shape)
    return out


class Speller:
    """Spells tokens by a table of look-alike letters; remembers what it spelled."""

    def __init__(self, forms: dict[str, dict[str, str]]):
        self.forms = forms
        self.known: dict[str, str] = {}

    def script_sets(self, token: str) -> list[frozenset[str]]:
        """The scripts each character of a token could be read in; empty for marks and characters of other scripts."""
        sets = [frozenset(self.forms[c]) if c in self.forms else frozenset(s for s in (_script(c),) if s) for c in token]
        return [s | {JAPANESE} if s & set(JOINT) else s for s in sets]

    def resolved(self, token: str) -> frozenset[str]:
        """The scripts in which the whole token could be spelled; empty: mixed."""
        sets = [s for s in self.script_sets(token) if s]
        return frozenset.intersection(*sets) if sets else frozenset()

    def kind(self, token: str) -> str:
        """'mixed' if some part has no script all its characters share, 'whole' if some part could be spelled in several scripts, else 'single'."""
        kinds = set()
        for part in self.parts(token):
            shared, sets = self.resolved(part), [s for s in self.script_sets(part) if s]
            kinds.add("mixed" if sets and not shared else "whole" if len(shared - {JAPANESE}) > 1 else "single")
        return "mixed" if "mixed" in kinds else "whole" if "whole" in kinds else "single"

    def parts(self, token: str) -> list[str]:
        """A token cut where it passes between Japanese and other scripts; marks stay with what they follow."""
        out: list[str] = []
        last = None
        for c, s in zip(token, self.script_sets(token)):
            now = JAPANESE in s if s else last
            if out and (now == last or last is None):
                out[-1] += c
            else:
                out.append(c)
            last = now
        return out

    def spelled(self, token: str) -> str:
        """The token in its consistent spelling."""
        done = self.known.get(token)
        if done is None:
            if len(self.known) > 1 << 18:
                self.known.clear()
            done = self.known[token] = "".join(map(self._part, self.parts(token)))
        return done

    def of_match(self, found: regex.Match) -> str:
        token = found[0]
        return token if token.isascii() else self.known.get(token) or self.spelled(token)

    def _part(self, part: str) -> str:
        if not any(c in self.forms for c in part):
            return part
        sets = self.script_sets(part)
        if any(JAPANESE in s for s in sets):
            return self._japanese(part)
        shared = self.resolved(part)
        if shared:
            script = next(s for s in PREFERRED if s in shared)
            return "".join(self.forms[c][script] if c in self.forms else c for c in part)
        sure = [next(iter(s)) if len(s) == 1 else "" for s in sets]
        out = []
        for i, c in enumerate(part):
            if c not in self.forms:
                out.append(c)
                continue
            near = [(abs(i - j), j > i, s) for j, s in enumerate(sure) if s in sets[i]]
            script = min(near)[2] if near else next(s for s in PREFERRED if s in sets[i])
            out.append(self.forms[c][script])
        return "".join(out)

    def _japanese(self, part: str) -> str:
        """Each look-alike in the script its neighbours speak for.

        Beside katakana: katakana. Else: kana that hiragana has too are hiragana, unless a letter follows that can only be
        katakana or kanji; two or more letters that could be katakana are, unless a kanji goes before; a single one is a
        kanji. へ that no katakana follows is hiragana, a particle. The long-vowel sign follows kana; before つ and kanji it is the kanji for one, as it is where no kana goes before.
        """
        out: list[str] = []
        last = ""
        for i, c in enumerate(part):
            shape = self.forms.get(c)
            if shape is None:
                out.append(c)
                last = _script(c) or last
                continue
            end = next((j for j in range(i + 1, len(part)) if part[j] not in self.forms), len(part))
            after = _script(part[end]) if end < len(part) else ""
            follows = self.forms[part[i + 1]] if end > i + 1 else {}
            begun = i > 0 and part[i - 1] in self.forms and last == KATAKANA
            if shape.get(KATAKANA) == "ー":
                kana = last == KATAKANA or (last == HIRAGANA and after != HAN and part[end : end + 1] != "つ")
            elif shape.get(HIRAGANA) == "へ" and end == i + 1:
                kana = after == KATAKANA
            elif HIRAGANA in shape:
                kana = last == KATAKANA or after == KATAKANA or (HAN in follows and follows.get(KATAKANA) != "ー")
            else:
                kana = last == KATAKANA or after == KATAKANA or (last != HAN and (bool(follows) or begun))
            script = KATAKANA if kana and KATAKANA in shape else HIRAGANA if HIRAGANA in shape else HAN
            out.append(shape[script])
            last = script
        return "".join(out)


_SPELLER = Speller(FORMS)


def consistent(text: str | None, speller: Speller = _SPELLER) -> str | None:
    """``text`` in the one form that all texts share that look like it; null stays null, '' stays ''."""
    if text is None:
        return None
    return _plain_all(text, speller)


def _plain_all(text: str, speller: Speller) -> str:
    if text.isascii() and not _CONTROL.search(text):
        return text
    return _TOKEN.sub(speller.of_match, _without_tokens(text))


def _without_tokens(text: str) -> str:
    """``text`` with all but the spelling of its tokens normalised."""
    text = _composed(_UNSEEN.sub("", text)).replace("\r\n", "\n").translate(_PLAIN)
    return _UNSEEN.sub("", _composed(text))


def _composed(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


class _Plain(dict):
    """Plain form by code point in width, blank and sign, worked out when first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = c if 0xD800 <= point < 0xE000 else " " if _BLANK.fullmatch(c) else SIGN_OF.get(w := _width(c), w)
        return self[point]


_PLAIN = _Plain()
#: Stands between the texts of a batch; no text of UTF-8 holds it.
_BETWEEN = "\ud800"


def consistent_all(texts: list[str | None], speller: Speller) -> list[str | None]:
    """``consistent`` of each text: all are handled as one, in a few passes."""
    done = _plain_all(_BETWEEN.join([t or "" for t in texts]) + _BETWEEN, speller).split(_BETWEEN)
    return [None if t is None else d for t, d in zip(texts, done)]


def with_consistent(rows: DataFrame, text: str, to: str, forms: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Adds column ``to`` (in place of one of that name): ``text`` in its consistent form. Arrow batches, no shuffle. ``forms``: of ``looks``, FORMS without."""
    rows = rows.drop(to) if to != text else rows.withColumnRenamed(text, text := f"{text}__given")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{to}` string"
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(forms or FORMS)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(consistent_all(b.column(at).to_pylist(), speller), pa.string())], names=[*b.schema.names, to])

    return rows.mapInArrow(run, schema).drop(f"{to}__given")


def confused_tokens(rows: DataFrame, text: str, forms: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """token, kind ('mixed' or 'whole'), spelling, occurrences of the tokens that hold look-alike letters and aren't of a single script. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, kinds = Speller(forms or FORMS), {}
        for b in batches:
            found = Counter(_TOKEN.findall(_without_tokens(_BETWEEN.join(pc.drop_null(b.column(0)).to_pylist()))))
            for t in found:
                if t not in kinds:
                    kinds[t] = speller.kind(t) if any(c in speller.forms for c in t) else "single"
            rows = [(t, kinds[t], speller.spelled(t), n) for t, n in found.items() if kinds[t] != "single"]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["token", "kind", "spelling", "n"])

    return rows.select(text).mapInArrow(run, "token string, kind string, spelling string, n bigint").groupBy("token", "kind", "spelling").agg(F.sum("n").alias("occurrences"))


#: Stored texts of a class of equal look that one task pairs up at a time.
PAIRED = 2_000


def look_forms(rows: DataFrame, key: str, text: str, forms: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """id, body, form of each distinct (id, body), neither null; written once."""
    given = rows.select(F.col(key).alias("id"), F.col(text).alias("body")).where("id IS NOT NULL AND body IS NOT NULL").distinct()
    return materialised(with_consistent(given, "body", "form", forms), "forms")


def look_classes(rows: DataFrame, key: str, text: str, forms: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """form, representative (the least stored text), variants (stored texts), members (ids) of each class of equal look stored in more than one way: a row a class, no pairs."""
    counted = look_forms(rows, key, text, forms).groupBy("form", "body").agg(F.count("*").alias("n"))
    return counted.groupBy("form").agg(F.min("body").alias("representative"), F.count("*").alias("variants"), F.sum("n").alias("members")).where("variants > 1")


def same_look_pairs(rows: DataFrame, key: str, text: str, forms: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """id_a < id_b of rows with different keys whose texts look the same but are stored in other characters.

    Rows with a null key or text are left out. Pairs are made of a class's distinct stored texts, never of its rows: a text
    stored alike a million times is one, and a class stored in one way makes no pair. Then each pair of texts
    meets the ids of both: what is joined is what comes out. Stored texts of a large class are cut into sections.
    """
    members = look_forms(rows, key, text, forms)
    variants = members.select("form", "body").distinct()
    classes = variants.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form", F.ceil(F.col("n") / PAIRED).cast("int").alias("sections"))
    of_class = materialised(variants.join(classes, "form"), "variants")
    section = F.pmod(F.xxhash64("body"), F.col("sections").cast("bigint")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("sections") - 1))
    a = of_class.select("form", F.col("body").alias("body_a"), section.alias("sa"), every.alias("sb"))
    b = of_class.select("form", F.col("body").alias("body_b"), section.alias("sb"), every.alias("sa"))
    texts = a.join(b, ["form", "sa", "sb"]).where("body_a < body_b").select("body_a", "body_b")
    stored = members.join(of_class.select("body"), "body", "left_semi").select("id", "body")
    met = texts.join(stored.select(F.col("body").alias("body_a"), F.col("id").alias("x")), "body_a").join(stored.select(F.col("body").alias("body_b"), F.col("id").alias("y")), "body_b").where("x <> y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
