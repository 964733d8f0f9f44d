"""Whitespace, case and number rules of the report texts, as column expressions.

Whitespace is the wide class WS (no-break, ideographic and zero-width no-break spaces included), never the engine's own ``\\s`` or ``trim``.
Patterns end in ``\\z``: ``$`` would also match before a last line break. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same class for Java's patterns: most letters of a Korean text are told from whitespace by the range alone, not by each of its parts.
WS = rf"[\x00-\u3000\uFEFF&&{PLAIN_WS}]"
WS_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Most texts have no character of these, and so no whitespace but spaces and line breaks.
_RARE = r"[^\n\x20-\x7E\u3001-\uFEFE]"
#: A number whose thousands are parted by commas, with or without parentheses.
COMMA_NUMBER = r"\(?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once.

    Columns that are used several times would be written out at each use when projections collapse, and again inside each other; a
    lambda's variable never is.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(array: str | Column) -> Column:
    """An array to explode, without nulls.

    Of an array that is a plain column Spark infers filters over its size, and moves them down to where the column is made, into a join's
    condition too: what it is made of would be worked out twice more. Of an expression it infers none.
    """
    return F.array_compact(array)


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WS_CHARACTERS))


def compact(value: Column) -> Column:
    """Without any whitespace, in lower case."""
    return F.lower(unspaced(text(value)))


def unspaced(value: Column) -> Column:
    """Without any whitespace."""
    plain = lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return let(value, lambda x: F.when(x.rlike(_RARE), F.regexp_replace(x, f"{WS}+", "")).otherwise(plain(x)))


def spaces(value: Column) -> Column:
    """Each whitespace character but line breaks as one space."""
    return let(value, lambda x: F.when(x.rlike(_RARE), F.regexp_replace(x, rf"[{WS}&&[^\n]]", " ")).otherwise(x))


def squeezed(value: Column) -> Column:
    """Each run of whitespace as one space, in lower case; not trimmed."""
    return F.lower(F.regexp_replace(text(value), f"{WS}+", " "))


def lines(value: Column) -> Column:
    """The text cut at line breaks; several in a row cut once."""
    return F.split(text(value), r"\n+")


def matches(value: Column, pattern: str) -> Column:
    """How many leftmost, non-overlapping matches."""
    return F.regexp_count(value, F.lit(pattern))


def has_keyword(compact_text: Column, keyword: str) -> Column:
    """Is the keyword there, with whatever whitespace? Whatever the squeezed text holds, the compact one holds without its spaces."""
    return compact_text.contains("".join(keyword.lower().split()))


def hits(compact_text: Column, keywords: list[str]) -> Column:
    """How many of the keywords are there."""
    total = F.lit(0)
    for keyword in keywords:
        total = total + has_keyword(compact_text, keyword).cast("int")
    return total


def first_or_null(value: Column) -> Column:
    """regexp_extract gives "" where nothing matches; here that is null."""
    return F.nullif(value, F.lit(""))


def last_match_at(value: Column, pattern: str) -> Column:
    """Where the last match begins (from 0), null without a match.

    What follows the last match is the last part of the text cut at all matches, so its place follows from three lengths.
    """
    last = F.element_at(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), -1)
    rest = F.element_at(F.split(value, pattern), -1)
    return F.when(F.regexp_count(value, F.lit(pattern)) > 0, F.length(value) - F.length(rest) - F.length(last))


def number_of(value: Column) -> Column:
    """A text as a number: blank is 0, what is no decimal number is null. Only clean text is ever cast."""
    t = trimmed(text(value))
    plain = t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z")
    return F.when(t == "", F.lit(0.0)).when(plain, t.try_cast("double"))


def rounded(value: Column, digits: int = 2) -> Column:
    """Halves go up, also below zero; null and NaN are 0."""
    scale = float(10**digits)
    v = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.floor(v * scale + 0.5).cast("double") / scale


def page_range(start: Column, end: Column) -> Column:
    """[start .. end]; empty where the end is before the start."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def html_escaped(value: Column) -> Column:
    out = text(value)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
