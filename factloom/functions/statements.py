"""Statement titles, the slice of a page that belongs to a statement, and what a page shows of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import COMMA_NUMBER, WS, compact, hits, last_match_at, let, lines, matches, squeezed, text, trimmed
from .vocabulary import CASH_FLOW_TAIL, ROW_KEYWORDS, STATEMENT_TYPES

#: How a title line reads once its section number is cut off.
TITLE_PATTERNS = {
    "income_statement": r"^(?:연결|개별|별도)?(?:포괄)?손익계산서\z",
    "balance_sheet": r"^(?:연결|개별|별도)?(?:포괄)?재무상태표\z",
    "cash_flow_statement": r"^(?:연결|개별|별도)?(?:포괄)?현금흐름표\z",
    "equity_changes": r"^(?:연결|개별|별도)?자본변동표\z",
}
#: Section headings that tell the scope of what follows; of equal places the earlier in this list counts.
SCOPE_HEADINGS = [
    (r"\d+(?:-\d+)?\. *연결 *재무제표", "consolidated"),
    (r"연결 *재무제표 *주석", "consolidated"),
    (r"\d+(?:-\d+)?\. *(?:개별|별도) *재무제표", "separate"),
    (r"\d+\. *재무제표(?! *주석)", "separate"),
    (r"(?:개별|별도) *재무제표 *주석", "separate"),
]
_NAMES = "(?:포괄재무상태표|재무상태표|포괄손익계산서|손익계산서|자본변동표|포괄현금흐름표|현금흐름표)"
_PREFIX = r"^\d+(?:-\d+)?\."
#: A comma number, a zero that stands alone, or any hyphen.
_VALUE_MARK = COMMA_NUMBER + r"|(?<!\d)0(?!\d)|-"


def title_type(line: Column) -> Column:
    """The statement that the line is the title of, else null. Sections count from 1 to 4, as do their parts."""
    return let(compact(line), _title_type)


def _names_a_statement(c: Column) -> Column:
    return c.contains("손익계산서") | c.contains("재무상태표") | c.contains("현금흐름표") | c.contains("자본변동표")


def _title_type(c: Column) -> Column:
    pure = F.regexp_replace(c, _PREFIX, "")
    named = F.when(pure.rlike(TITLE_PATTERNS["income_statement"]), "income_statement")
    for kind in ("balance_sheet", "cash_flow_statement", "equity_changes"):
        named = named.when(pure.rlike(TITLE_PATTERNS[kind]), kind)
    fits = F.length(c).between(1, 50) & _names_a_statement(c) & ~c.contains("주석") & ~c.contains("인식") & ~c.contains("관련")
    return F.when(fits & (~c.rlike(_PREFIX) | c.rlike(r"^0*[1-4](?:-0*[1-4])?\.")), named)


def titles(page_lines: Column) -> Column:
    """All titles among the lines: index, statement_type, has_section_prefix. Lines without the last letter of a statement's name are done with one look."""

    def told(line: Column, i: Column) -> Column:
        title = let(compact(line), lambda c: F.struct(i.alias("index"), _title_type(c).alias("statement_type"), c.rlike(_PREFIX).alias("has_section_prefix")))
        return F.when(line.contains("표") | line.contains("서"), title)

    return F.filter(F.transform(page_lines, told), lambda t: t.statement_type.isNotNull())


def has_title(found: Column, statement_type: Column) -> Column:
    return F.exists(found, lambda t: t.statement_type == statement_type)


def slice_bounds(found: Column, statement_type: Column) -> Column:
    """start and stop (line places, stop excluded; null: open) of the part of a page that belongs to a statement.

    From the statement's first title without a section number, else its last title with one, to the next title without one. Without
    a title of its own: what comes before the first title without a section number, else the whole page.
    """
    pure = F.filter(found, lambda t: (t.statement_type == statement_type) & ~t.has_section_prefix)
    numbered = F.filter(found, lambda t: t.statement_type == statement_type)
    first = F.coalesce(F.get(pure, F.lit(0))["index"], F.try_element_at(numbered, F.lit(-1))["index"])

    def until_next(start: Column) -> Column:
        after = F.filter(found, lambda t: ~t.has_section_prefix & (t["index"] > F.coalesce(start, F.lit(-1))))
        return F.struct(start.alias("start"), F.get(after, F.lit(0))["index"].alias("stop"))

    return let(first, until_next)


def is_whole(at: Column) -> Column:
    return at["start"].isNull() & at["stop"].isNull()


def cut(page_text: Column, page_lines: Column, at: Column) -> Column:
    """The text within the bounds."""
    begin = F.coalesce(at["start"], F.lit(0))
    part = F.slice(page_lines, begin + 1, F.coalesce(at["stop"], F.size(page_lines)) - begin)
    return F.when(is_whole(at), text(page_text)).otherwise(F.array_join(part, "\n"))


def statement_slice(page_text: Column, page_lines: Column, found: Column, statement_type: Column) -> Column:
    """The part of a page that belongs to a statement."""
    return let(slice_bounds(found, statement_type), lambda at: cut(page_text, page_lines, at))


def value_lines(page_text: Column) -> Column:
    """Lines with at least two values."""
    return F.size(F.filter(lines(page_text), lambda line: matches(line, _VALUE_MARK) >= 2))


def look(segment: Column) -> Column:
    """What evidence() of every statement needs of a text: compact, numbers (with commas), valued (lines with two values)."""
    return let(segment, lambda x: F.struct(compact(x).alias("compact"), F.coalesce(matches(x, COMMA_NUMBER), F.lit(0)).alias("numbers"), value_lines(x).alias("valued")))


def of_look(seen: Column, statement_type: str) -> Column:
    return F.struct(hits(seen["compact"], ROW_KEYWORDS[statement_type]).alias("rows"), seen["numbers"].alias("numbers"), seen["valued"].alias("valued"))


def evidence(segment: Column, statement_type: str) -> Column:
    """rows (keywords of the statement's rows), numbers (with commas) and valued (lines) of a text."""
    return let(look(segment), lambda seen: of_look(seen, statement_type))


def look_at_slice(segment: Column, page_text: Column, page_look: Column) -> Column:
    """look() of a page's slice, given that of the page: most slices are the page or empty."""
    nothing = F.struct(F.lit("").alias("compact"), F.lit(0).alias("numbers"), F.lit(0).alias("valued"))
    return F.when(segment == "", nothing).when(segment == page_text, page_look).otherwise(look(segment))


def by_type(statement_type: Column, make) -> Column:
    """make(type) of the row's own type."""
    out = F.when(statement_type == STATEMENT_TYPES[0], make(STATEMENT_TYPES[0]))
    for kind in STATEMENT_TYPES[1:]:
        out = out.when(statement_type == kind, make(kind))
    return out


def _goes_on(e: Column) -> Column:
    # a text that is blank shows nothing of these
    return ((e.rows >= 1) & (e.numbers >= 2)) | (e.valued >= 2)


def is_strong(e: Column) -> Column:
    """Is the evidence that of a statement's body?"""
    return (e.rows >= 1) & (e.numbers >= 6) & (e.valued >= 2)


def continues(segment: Column, statement_type: str) -> Column:
    """Does the segment go on with the statement?"""
    return let(evidence(segment, statement_type), _goes_on)


def goes_on_with(seen: Column, statement_type: str) -> Column:
    """continues() of a look()."""
    return let(of_look(seen, statement_type), _goes_on)


def shown(seen: Column, statement_type: str) -> Column:
    """evidence() with goes_on and strong, all of one look() at the segment."""
    return let(of_look(seen, statement_type), lambda e: F.struct(e.rows.alias("rows"), e.numbers.alias("numbers"), e.valued.alias("valued"), _goes_on(e).alias("goes_on"), is_strong(e).alias("strong")))


def cash_flow_tail(page_text: Column) -> Column:
    # all of its words are about cash
    about_cash = page_text.contains("현") & page_text.contains("금") & (matches(page_text, COMMA_NUMBER) >= 4)
    return F.when(about_cash, let(compact(page_text), lambda c: hits(c, CASH_FLOW_TAIL) >= 2)).otherwise(False)


def looks_like_contents(page_text: Column) -> Column:
    named = F.lower(page_text).contains("table") & squeezed(page_text).contains("table of contents")
    return page_text.contains("목차") | named | (page_text.contains("...") & (matches(page_text, r"\.\.\.") > 20))


def starts_other_section(page_text: Column) -> Column:
    """Do the first six lines open the notes or another section that is no statement?"""
    head = F.slice(F.filter(F.transform(lines(page_text), trimmed), lambda x: x != ""), 1, 6)

    def opens(s: Column, c: Column) -> Column:
        numbered = s.rlike(r"^\d+(?:-\d+)?\. *(?:연결 *)?재무제표 *주석") | s.rlike("^(?:연결 *)?재무제표 *주석")
        return numbered | c.startswith("주석") | c.startswith("재무제표주석") | c.startswith("연결재무제표주석") | c.startswith("외부감사실시내용")

    # without any line both texts are empty, and open nothing
    told = let(head, lambda h: let(F.struct(squeezed(F.array_join(h, " ")).alias("s"), compact(F.array_join(h, "")).alias("c")), lambda t: opens(t.s, t.c)))
    # most pages hold neither word and are done with one look
    named = (page_text.contains("주") & page_text.contains("석")) | (page_text.contains("외") & page_text.contains("부"))
    return F.when(named, told).otherwise(False)


def heading_scope(squeezed_text: Column) -> Column:
    """The scope that the last section heading on the page tells, else null."""

    def last(s: Column) -> Column:
        found = [F.struct(last_match_at(s, pattern).alias("at"), F.lit(-order).alias("order"), F.lit(scope).alias("scope")) for order, (pattern, scope) in enumerate(SCOPE_HEADINGS)]
        return F.when(s.contains("재무제표"), F.array_max(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))["scope"])

    return let(squeezed_text, last)


def page_scope(page_text: Column, carried: Column) -> Column:
    """Scope by a title, by the last heading up to and with the page (carried), or by the word itself."""
    other = F.coalesce(carried, F.when(F.lower(page_text).contains("consolidated"), "consolidated").otherwise("unknown"))
    joint = page_text.contains("연결") & page_text.rlike(f"연결{WS}*{_NAMES}")
    alone = (page_text.contains("개별") | page_text.contains("별도")) & page_text.rlike(f"(?:개별|별도){WS}*{_NAMES}")
    return F.when(joint, "consolidated").when(alone, "separate").otherwise(other)
