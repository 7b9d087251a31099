"""Registry of the named queries and small helpers for their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.derived import AMENITIES, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows (if any)."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def over(views: str, body: str) -> str:
    """Check SQL that starts from derived views: ``over('listings', 'SELECT ...')``."""
    ctes = ", ".join(f"{v} AS ({view_sql(v)})" for v in views.split())
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def rnd(x: str, digits: int) -> str:
    """Exact half-even rounding of the binary value."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def hav(lat1: str, lng1: str, lat2: str, lng2: str, radius: float) -> str:
    a = (
        f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians(({lng2}) - ({lng1})) / 2), 2))"
    )
    return f"({radius} * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


METERS = 6371008.8
MILES = 3959.0


def amenity_text(bits: str) -> str:
    """Comma list of the amenities behind a bit set."""
    parts = ", ".join(f"CASE WHEN ({bits} & {1 << i}) <> 0 THEN '{a}' END" for i, a in enumerate(AMENITIES))
    return f"concat_ws(',', {parts})"
