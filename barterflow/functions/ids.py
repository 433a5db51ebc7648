"""Identifiers that are numbers, however they are written."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks and characters without width, as a Java character class body.
BLANK_CLASS = r"\s\x{85}\x{A0}\x{AD}\x{61C}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}"


@lru_cache(1)
def _digits() -> tuple[str, str]:
    """Every decimal digit of Unicode beside ASCII, and the ASCII digit it stands for."""
    pairs = [(chr(c), str(unicodedata.digit(chr(c)))) for c in range(0x80, min(sys.maxunicode, 0xFFFF) + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def number_key(col: Column | str) -> Column:
    """The identity of an id: its decimal digits without leading zeros; null where the id is null or blank.

    Digits of any script, a leading ``+``, and blanks or zero-width characters around or
    inside count for nothing. An id that is no number is its own identity, without blanks.
    """
    c = F.col(col) if isinstance(col, str) else col
    plain = c.rlike(r"\A[1-9][0-9]*\z")
    bare = F.regexp_replace(F.translate(c, *_digits()), f"[{BLANK_CLASS}]+", "")
    number = F.regexp_extract(bare, r"\A\+?0*([0-9]+)\z", 1)
    return F.when(plain, c).when(bare == "", F.lit(None)).when(number != "", number).otherwise(bare)


def sequence_millis(col: Column | str, epoch_ms: int) -> Column:
    """Milliseconds held in the upper bits of a 64-bit sequence id, null where it is no such number."""
    c = F.col(col) if isinstance(col, str) else col
    return F.shiftright(number_key(c).try_cast("bigint"), 22) + F.lit(epoch_ms)
