"""Text of posts: cleaning, links, times, names. JVM expressions; NFKC alone needs Arrow."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barterflow.functions.ids import sequence_millis

#: What counts as white space at the ends of a text and between words of a pattern (a Java character class body).
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Milliseconds of the epoch of status ids, link hosts of the same site, and characters that continue a name.
STATUS_EPOCH_MS = 1288834974657
SITE, SITE_HOSTS = "x.com", ("twitter.com", "www.twitter.com", "www.x.com", "x.com")
NAME_CHARS = "ぁ-んァ-ヶー一-龠々"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without white space of any kind at both ends (Spark's own trim takes U+0020 only)."""
    return F.regexp_replace(col(c), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def clean_text(c: Column | str) -> Column:
    """No-break spaces, tabs and runs of blanks as one blank, at most one empty line, ends trimmed; null stays null."""
    x = F.regexp_replace(F.translate(col(c), chr(0xA0), " "), r"[\t\r]+", " ")
    return trim(F.regexp_replace(F.regexp_replace(x, " +", " "), r"\n{3,}", "\n\n"))


def strip_highlight(c: Column | str) -> Column:
    """Without the search engine's highlight marks (real or written-out tabs around START and END), then cleaned."""
    s = f"[{SPACE}]*"
    x = F.regexp_replace(col(c), rf"(?i)\t{s}(?:START|END){s}\t", "")
    return clean_text(F.regexp_replace(x, rf"(?i)\\t{s}(?:START|END){s}\\t", ""))


def status_url(c: Column | str, base_host: str = "search.yahoo.co.jp") -> Column:
    """https://<site>/<user>/status/<digits> of a link to a status; null for any other link, an unreadable one, an empty one and null.

    Query string, fragment and what follows the digits are dropped; a path alone counts on ``base_host``.
    """
    x = trim(c)
    absolute = F.regexp_extract(x, r"\A(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?(/[^?#]*)?", 1)
    path = F.regexp_extract(x, r"\A(?:(?i:https?)://[^/?#]*)?(/[^?#]*)", 1)
    host = F.when(absolute != "", F.lower(absolute)).when(x.startswith("/"), F.lit(base_host))
    user, digits = F.regexp_extract(path, r"\A/([^/]+)/status/([0-9]+)", 1), F.regexp_extract(path, r"\A/([^/]+)/status/([0-9]+)", 2)
    return F.when(host.isNotNull() & (digits != ""), F.concat(F.lit(f"https://{SITE}/"), user, F.lit("/status/"), digits))


def part_of(c: Column | str, pattern: str) -> Column:
    """First group of ``pattern``; null where it doesn't match."""
    return F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit(""))


def status_id(c: Column | str) -> Column:
    return part_of(c, r"/status/([0-9]+)")


def author(c: Column | str) -> Column:
    return part_of(c, rf"\Ahttps://{re.escape(SITE)}/([^/]+)/status/")


def id_time(c: Column | str, epoch_ms: int = STATUS_EPOCH_MS) -> Column:
    """The time in the upper bits of a status id; null for anything but a number."""
    return F.timestamp_millis(sequence_millis(c, epoch_ms))


def entry_time(created: Column | str, ident: Column | str) -> Column:
    """Seconds or milliseconds (above 10^10) since 1970; where that is missing or not positive, the time in the id."""
    n = col(created).cast("double")
    ms = F.when(n > 1e10, n).otherwise(n * 1000).cast("bigint")
    return F.when(n > 0, F.timestamp_millis(ms)).otherwise(id_time(ident))


def entry_url(url: Column | str, user: Column | str, ident: Column | str) -> Column:
    """The entry's own link, else one made of its user and id, else null."""
    made = F.when(col(user) != "", F.concat(F.lit(f"https://{SITE}/"), col(user), F.lit("/status/"), col(ident)))
    return F.coalesce(status_url(url), made)


def canonical_aliases(c: Column | str, aliases: Sequence[tuple[str, str]]) -> Column:
    """Each alias replaced by its name, in the order given; later aliases see what earlier ones wrote."""
    x = col(c)
    for alias, name in aliases:
        if alias:
            x = F.replace(x, F.lit(alias), F.lit(name))
    return x


def quoted(names: Sequence[str]) -> str:
    """Names as one alternation of a Java pattern, the longest first."""
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\&\-])", r"\\\1", n) for n in sorted(set(names), key=lambda n: (-len(n), n)))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no such function."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s), na_action="ignore")


#: Frequent misreadings, signs that stand for others, and blanks inside Japanese text, each a pattern and what stands for it.
MISREAD = (
    ("[カ力][一ー―−-]ド", "カード"),
    ("欲し[ぃい]", "欲しい"),
    ("出せ[るろ]", "出せる"),
    ("譲れ[るろ]", "譲れる"),
    ("[｜|¦]", " "),
    ("[：﹕]", ":"),
    ("／", "/"),
    ("[・•●]", " "),
    (rf"([{NAME_CHARS}])[ \t]+(?=[{NAME_CHARS}])", "$1"),
    (r"\n[ \t]+", "\n"),
    (r"[ \t]{2,}", " "),
)


def ocr_text(plain: Column | str) -> Column:
    """Text read from an image, already NFKC: frequent misreadings mended, bars and bullets as blanks, no blanks between Japanese characters."""
    x = col(plain)
    for pattern, to in MISREAD:
        x = F.regexp_replace(x, pattern, to)
    return clean_text(x)


def title_text(plain: Column | str) -> Column:
    """A title, already NFKC, reduced to kana and kanji; dashes become the long-vowel sign."""
    return F.regexp_replace(F.translate(col(plain), "―−‐‑–—", "ーーーーーー"), f"[^{NAME_CHARS}]", "")


#: Signs that part the words of a line read from an image (a Java character class body).
TITLE_PARTS = SPACE + r"，,，.。:：;；/／\\|｜()\[\]{}【】「」『』<>＜＞" + '"' + r"'`´^~_+=*×xX"


def title_tokens(plain: Column | str) -> Column:
    """Distinct titles of a text, already NFKC: each line whole, then its parts."""
    lines = F.split(col(plain), r"\r?\n")
    tokens = F.flatten(F.transform(lines, lambda line: F.concat(F.array(title_text(line)), F.transform(F.split(line, f"[{TITLE_PARTS}]+"), title_text))))
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def digits(plain: Column | str) -> Column:
    return F.regexp_replace(col(plain), "[^0-9]", "")


def star_marker(plain: Column | str, rank: int = 2) -> Column:
    """Whether a text, already NFKC, names a rarity of ``rank`` stars."""
    return col(plain).rlike(rf"(?i)(?:★|☆)[{SPACE}]*{rank}|{'☆' * rank}|星[{SPACE}]*{rank}|{rank}[{SPACE}]*(?:star|stars)")


def has_unnegated(plain: Column | str, negations: Sequence[str], patterns: Sequence[str]) -> Column:
    """Whether any pattern occurs once the negated phrases are blanked out. Which patterns reject a text is the caller's rule."""
    x = col(plain)
    for p in negations:
        x = F.regexp_replace(x, f"(?i){p}", " ")
    return F.coalesce(F.greatest(*[x.rlike(f"(?i){p}") for p in patterns], F.lit(False)), F.lit(False))


def likely_trade_image(body: Column | str, urls: Column | str, words: Sequence[str], other_words: Sequence[str], hosts: Sequence[str]) -> Column:
    """A word of each of two groups in the body, or an image from a known host."""
    b = F.coalesce(col(body), F.lit(""))
    both = b.rlike(f"(?i)({'|'.join(words)})") & b.rlike(f"(?i)({'|'.join(other_words)})")
    return both | F.coalesce(F.exists(col(urls), lambda u: u.rlike(f"(?i){'|'.join(re.escape(h) for h in hosts)}")), F.lit(False))

