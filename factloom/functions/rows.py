"""Account rows of a statement's text: label, values, unit, period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import COMMA_NUMBER, PLAIN_WS, WS, WS_CHARACTERS, first_or_null, let, spaces, trimmed, unspaced
from .vocabulary import NOT_ACCOUNT_PARTS, NOT_ACCOUNTS

#: Fixed values, here and in the functions below: patterns of values, units, periods and labels. Plain numbers below a thousand are no values.
_VALUE = rf"(?:-|0|{COMMA_NUMBER})"
#: A line up to the end of its last word that is no value; the search goes backwards from the line's end.
_WORDS = rf"(?s)^(?:.*[ \n])?(?!{_VALUE}(?:[ \n]|\z))[^ \n]+"
#: Roman, circled and plain numbering, each once, in this order.
_ROMAN, _CIRCLED, _PLAIN = rf"(?i:[IVXLCDMⅠ-ⅿ]+)[\x00-\u3000\uFEFF&&[{PLAIN_WS[1:-1]}.)]]+", rf"[①-⑳❶-❿]{WS}*", rf"\d+[.)]{WS}*"
_NUMBERING = rf"^(?:{_ROMAN}(?:{_CIRCLED})?(?:{_PLAIN})?|{_CIRCLED}(?:{_PLAIN})?|{_PLAIN})"


def parsed_line(line: Column) -> Column:
    """label, values: the values that end the line, the first three, and the label before them; null for any other line."""

    def told(line: Column, words: Column) -> Column:
        values = F.slice(F.split(_spaced(line.substr(F.length(words) + 1, F.length(line))), " "), 1, 3)
        label = clean_label(F.btrim(_spaced(words), F.lit(WS_CHARACTERS + ":·ㆍ-")))
        row = let(F.struct(label.alias("label"), values.alias("values")), lambda r: F.when((r["label"] != "") & (r["values"][0] != ""), r))
        return F.when((words != "") & (F.length(words) < F.length(line)), row)

    return let(spaces(line), lambda x: let(F.regexp_extract(x, _WORDS, 0), lambda words: told(x, words)))


def _spaced(part: Column) -> Column:
    """Words with a single space between them; part has no other whitespace than spaces and line breaks."""
    return F.trim(let(part, lambda x: F.when(x.contains("  ") | x.contains("\n"), F.regexp_replace(x, r"[ \n]+", " ")).otherwise(x)))


def clean_label(label: Column) -> Column:
    """Without roman, circled or plain numbering in front and note numbers behind."""
    out = F.regexp_replace(label, _NUMBERING, "")
    noted = lambda x: F.when(F.right(x, F.lit(1)).between("0", "9"), F.regexp_replace(x, rf"{WS}+\d+(?:{WS}*,{WS}*\d+)*\z", "")).otherwise(x)
    return trimmed(let(out, noted))


def is_account(label: Column) -> Column:
    """Can the label name an account?"""

    def in_latin(lower: Column) -> Column:
        found = F.lit(False)
        for part in filter(str.isascii, NOT_ACCOUNT_PARTS):
            found = found | lower.contains(part)
        return found

    def names_one(c: Column) -> Column:
        banned = c.isin(NOT_ACCOUNTS) | (c.startswith("제") & c.rlike(r"^제\d+(?:\([^)]+\))?기")) | (c.startswith("20") & c.rlike(r"^20\d{2}[.\-/]")) | c.contains("전자공시시스템")
        for part in NOT_ACCOUNT_PARTS:
            if not part.isascii():
                banned = banned | c.contains(part)
        # only parts in Latin letters have cases, and these hold a dot or a p: most labels need not be put in lower case
        latin = F.when(c.contains(".") | c.contains("p") | c.contains("P"), let(F.lower(c), in_latin)).otherwise(False)
        return F.length(c).between(2, 80) & ~banned & ~latin & ~(label.contains(",") & label.rlike(COMMA_NUMBER)) & label.rlike("[가-힣a-zA-Z]")

    return let(unspaced(label), names_one)


def unit_scale(page_text: Column) -> Column:
    """unit, scale: as captioned in the text, else KRW."""

    def pair(unit: str, scale: int) -> Column:
        return F.struct(F.lit(unit).alias("unit"), F.lit(scale).cast("long").alias("scale"))

    def named(c: Column) -> Column:
        return F.when(c.contains("단위:천원") | c.contains("단위：천원"), pair("천원", 1_000)).when(c.contains("단위:백만원"), pair("백만원", 1_000_000)).when(c.contains("단위:억원"), pair("억원", 100_000_000)).otherwise(pair("KRW", 1))

    # most texts are done with one look; in lower case these words are the same
    captioned = page_text.contains("단") & page_text.contains("위")
    return F.when(captioned, let(unspaced(page_text), named)).otherwise(pair("KRW", 1))


def period_parts(page_text: Column) -> Column:
    """What a text says of its period: day (of a balance sheet, or null) and other (a range's year, the number of the business year, or "")."""
    day = F.when(page_text.contains("31"), first_or_null(F.regexp_extract(page_text, rf"(20\d{{2}})[.\-/]{WS}*0?12[.\-/]{WS}*0?31", 1)))
    year = F.when(page_text.contains("01") & page_text.contains("31"), first_or_null(F.regexp_extract(page_text, rf"(?s)20\d{{2}}[.\-/]{WS}*01[.\-/]{WS}*01.*?(20\d{{2}})[.\-/]{WS}*12[.\-/]{WS}*31", 1)))
    numbered = F.regexp_extract(page_text, rf"제{WS}*\d+(?:\([^)]+\))?{WS}*기", 0)
    term = F.when(page_text.contains("제") & page_text.contains("기"), first_or_null(F.regexp_replace(numbered, f"{WS}+", "")))
    return F.struct(F.concat(day, F.lit(".12.31")).alias("day"), F.coalesce(F.concat(F.lit("FY"), year), term, F.lit("")).alias("other"))


def period_of(parts: Column, statement_type: Column) -> Column:
    return F.coalesce(F.when(statement_type == "balance_sheet", parts["day"]), parts["other"])


def period(page_text: Column, statement_type: Column) -> Column:
    """A balance sheet's day, a range's year, the number of the business year, or ""."""
    return let(period_parts(page_text), lambda parts: period_of(parts, statement_type))


def period_labels(page_text: Column) -> Column:
    """The years in the text, latest first, six at most."""
    years = F.array_distinct(F.regexp_extract_all(page_text, F.lit(r"20\d{2}"), F.lit(0)))
    return F.slice(F.sort_array(years, asc=False), 1, 6)
