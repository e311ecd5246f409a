"""Named queries over the driver's tables, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.sources.adapter import DriverTables, oracle_with


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[DriverTables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, **ctes: str):
    """Register a query, the inventory lines it covers and its oracle."""

    def add(fn: Callable[[DriverTables], DataFrame]):
        assert name not in QUERIES, name
        body = (sql if sql.startswith("WITH ") else oracle_with(sql, **ctes)) if sql else None
        QUERIES[name] = Query(name, tuple(covers.split()), fn, body)
        return fn

    return add


# Results are compared by value, so doubles are rounded on both sides. The small
# shift keeps exact halves (averages of cents) from rounding differently.
_SHIFT = {3: 3e-7, 4: 3e-8, 6: 3e-10}


def r(c: Column | str, digits: int = 6) -> Column:
    if isinstance(c, str):
        return F.expr(f"round(cast({c} as double) + {_SHIFT[digits]!r}D, {digits})")
    return F.round(c.cast("double") + F.lit(_SHIFT[digits]), digits)


def sr(sql: str, digits: int = 6) -> str:
    return f"round(cast({sql} as double) + {_SHIFT[digits]!r}, {digits})"
