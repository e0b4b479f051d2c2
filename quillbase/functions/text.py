"""Text transforms of search indexes: normalising and splitting, as expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decomposition leaves alone.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "đ": "d", "ł": "l", "ø": "o", "ħ": "h", "ı": "i", "ŋ": "n", "ĸ": "k", "ſ": "s"}
WHITESPACE, WORD_BOUNDARY = "whitespace", "word_boundary"
#: Between the words of a search surface; no text holds it.
SEPARATOR = "￿"
_BREAKS = {WHITESPACE: r"[ \t\n\r]+", WORD_BOUNDARY: r"[\s\p{Z}\-‐-—]+"}
#: Hangul syllables and the jamo that they consist of, by the arithmetic of the Unicode standard.
_HANGUL, _LEADS, _VOWELS, _TAILS = (0xAC00, 0xD7A3), 0x1100, 0x1161, 0x11A7


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters with a canonical decomposition and its one letter, marks left out; those with several letters."""
    one, several = {}, {}
    for i in range(0xC0, 0x30000):
        c = chr(i)
        if _HANGUL[0] <= i <= _HANGUL[1] or not unicodedata.decomposition(c) or unicodedata.decomposition(c).startswith("<"):
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
        if base != c and len(base) == 1:
            one[c] = base
        elif len(base) > 1:
            several[c] = base
    return "".join(one), "".join(one.values()), several


def _jamo(c: Column) -> Column:
    """Hangul syllables as their jamo."""
    code = lambda x: F.ascii(x) - _HANGUL[0]
    four = lambda n: F.lpad(F.hex(n), 4, "0")
    parts = lambda x: F.concat(four((code(x) / 588).cast("int") + _LEADS), four((code(x) % 588 / 28).cast("int") + _VOWELS), F.when(code(x) % 28 > 0, four(code(x) % 28 + _TAILS)).otherwise(""))
    pieces = F.transform(F.split(c, "(?<=[가-힣])|(?=[가-힣])"), lambda x: F.when(x.rlike(r"\A[가-힣]\z"), F.decode(F.unhex(parts(x)), "UTF-16BE")).otherwise(x))
    return F.when(c.rlike("[가-힣]"), F.array_join(pieces, "")).otherwise(c)


def _fold(c: Column) -> Column:
    """Lower-case and decomposed, marks of composed letters left out."""
    a, b, several = _folds()
    one = {k: v for k, v in LETTERS.items() if len(v) == 1}
    out = F.translate(F.lower(c), a + "".join(one), b + "".join(one.values()))
    for k, v in (several | {k: v for k, v in LETTERS.items() if len(v) > 1}).items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return _jamo(out)


def normalize(c: Column) -> Column:
    """Lower-case, without marks, blanks, punctuation and symbols; connectors go too."""
    return F.regexp_replace(_fold(c), r"[\p{M}\p{Z}\p{P}\p{S}]", "")


def legacy_normalize(c: Column) -> Column:
    """The first form: lower-case without marks; blanks and punctuation stay."""
    a, b, _ = _folds()
    return F.regexp_replace(F.translate(F.lower(c), a, b), r"\p{M}", "")


def split(c: Column, on: str = WORD_BOUNDARY) -> Column:
    """Words, without empty ones. Word boundaries are blanks and hyphens."""
    return F.filter(F.split(c, _BREAKS[on]), lambda x: x != "")


def surface(*fields: Column, on: str = WORD_BOUNDARY, normalized: bool = True) -> Column:
    """All words of several fields in one string, a SEPARATOR before, between and behind them: split first, then normalised,
    each in one pass over the text. Null fields have no words."""
    parts = []
    for c in fields:
        words = F.regexp_replace(_fold(c) if normalized else c, _BREAKS[on], SEPARATOR)
        if normalized:
            words = F.regexp_replace(words, r"[\p{M}\p{Z}\p{P}\p{S}]", "")
        parts += [F.lit(SEPARATOR), F.coalesce(words, F.lit(""))]
    return F.concat(*parts, F.lit(SEPARATOR))


def tokens(*fields: Column, on: str = WORD_BOUNDARY, normalized: bool = True) -> Column:
    """The distinct tokens of several fields."""
    return F.array_distinct(F.filter(F.split(surface(*fields, on=on, normalized=normalized), SEPARATOR), lambda x: x != ""))


def normalize_term(s: str) -> str:
    """The same on the driver, for a query's terms."""
    out = "".join(LETTERS.get(c, c) for c in unicodedata.normalize("NFD", s.lower()))
    return "".join(c for c in out if unicodedata.category(c)[0] not in "MZPS")


def query_terms(s: str, on: str = WORD_BOUNDARY, normalized: bool = True) -> list[str]:
    parts = re.split(r"[ \t\n\r]+" if on == WHITESPACE else r"[\s\-‐-—]+", s)
    out = [normalize_term(p) if normalized else p for p in parts]
    return [p for p in dict.fromkeys(out) if p]
