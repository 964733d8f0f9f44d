"""Amounts, units and concepts of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, first_or_null, let, text, trimmed
from .vocabulary import CONCEPT_ALIASES

#: What an amount in a unit is multiplied by.
UNIT_FACTORS = {"KRW": 1, "원": 1, "천원": 1_000, "백만원": 1_000_000, "억원": 100_000_000}


def parsed_number(value: Column) -> Column:
    """The number that a cell shows; parentheses negate. Null, blank and "-" have none.

    Only digits, dots and hyphens count, and of those the longest number they begin with: "1.2.3" is 1.2, "12-3" is 12.
    """

    def signed(t: Column) -> Column:
        negative = t.startswith("(") & t.endswith(")")
        return F.when(t != "-", let(_leading_number(t), lambda n: F.when(negative, -n).otherwise(n) + F.lit(0.0)))  # adding zero turns -0 into 0

    return F.when(value.isNotNull(), let(trimmed(text(value)), signed))


def _leading_number(t: Column) -> Column:
    digits = F.regexp_replace(t, r"[^0-9.-]", "")
    found = let(digits, lambda d: F.when(d.contains("."), F.regexp_extract(d, r"^-?(?:\d+\.?\d*|\.\d+)", 0)).otherwise(F.regexp_extract(d, r"^-?\d+", 0)))
    return let(found, lambda n: first_or_null(n).try_cast("double"))


def amount(value: Column, unit: Column, scale: Column | None = None) -> Column:
    """The number times the unit's factor; for a unit without one, times the scale."""
    factors = F.create_map(*[F.lit(x) for name, times in UNIT_FACTORS.items() for x in (name, float(times))])
    factor = F.when(unit.isNotNull(), F.try_element_at(factors, unit))
    return parsed_number(value) * F.coalesce(factor, F.lit(1.0) if scale is None else scale.cast("double"), F.lit(1.0))


def unit_label(value: Column) -> Column:
    """A unit's Korean name; the order of the cases is part of the result ("hundred_million_KRW" is 백만원)."""
    return let(
        trimmed(F.coalesce(value, F.lit("KRW"))),
        lambda t: F.when(t.rlike(rf"(?i)thousand|천{WS}*원"), "천원")
        .when(t.rlike(rf"(?i)million|백{WS}*만{WS}*원"), "백만원")
        .when(t.rlike(rf"(?i)hundred{WS}*million|억{WS}*원"), "억원")
        .when(t.rlike("(?i)won|원|krw"), "KRW")
        .otherwise(F.coalesce(first_or_null(t), F.lit("KRW"))),
    )


def unescaped(value: Column) -> Column:
    r"""Written-out ``\uXXXX`` escapes as the characters they name."""
    t = text(value)
    as_json = F.concat(F.lit('{"t":"'), F.replace(F.regexp_replace(t, r"\\(?!u[0-9a-fA-F]{4})", r"\\\\\\\\"), F.lit('"'), F.lit('\\"')), F.lit('"}'))
    return F.when(t.rlike(r"\\u[0-9a-fA-F]{4}"), F.coalesce(F.get_json_object(as_json, "$.t"), t)).otherwise(t)


def _alias_key(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, rf"(?:{WS}|[(){{}}\[\]·ㆍ,.-])+", ""))


def concept(label: Column) -> Column:
    """The concept whose alias, the longest that the label holds, names it; else the label itself, 80 characters at most."""
    longest_first = sorted(CONCEPT_ALIASES, key=lambda pair: -len(pair[0]))

    def named(key: Column) -> Column:
        # a case each: inside a lambda one case of many branches goes through its list anew for each branch
        return F.coalesce(*[F.when(key.contains(alias), name) for alias, name in longest_first], first_or_null(F.left(key, F.lit(80))), F.lit("UnknownConcept"))

    return let(_alias_key(unescaped(label)), named)
