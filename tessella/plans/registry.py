"""Registry of the library's queries and of the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from tessella.plans.queries import QUERIES
from tessella.plans.sql import SQL

FLAGSHIP = "zone_demographics"


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
