"""JSON out of model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text, trimmed


def unfenced(raw: Column) -> Column:
    """Without the code fence that models put around JSON."""
    t = F.regexp_replace(trimmed(text(raw)), r"^```(?i:json)?[ \t\r\n]*", "")
    return trimmed(F.regexp_replace(t, r"```\z", ""))


def _valid(t: Column) -> Column:
    return F.try_parse_json(t).isNotNull()


def json_text(raw: Column) -> Column:
    """The response's JSON: as it stands, else from its first { to its last }; null where neither is JSON."""

    def braced(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        inner = F.when((first > 0) & t.contains("}") & (last > first), F.substring(t, first, last - first + 1))
        return let(inner, lambda x: F.when(_valid(x), x))

    return let(unfenced(raw), lambda t: F.when(_valid(t), t).otherwise(braced(t)))


def non_blank(value: Column) -> Column:
    """A response that says something, else null."""
    return F.nullif(trimmed(text(value)), F.lit(""))
