"""All queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from factloom.plans import oracle
from factloom.plans.queries import FOUND


def queries() -> dict:
    return dict(FOUND)


def oracle_sql() -> dict:
    return oracle.oracle_sql()
