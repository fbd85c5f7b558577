"""All reference-domain queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) as a query, with SQL that DuckDB gives the same rows for."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _load() -> None:
    from stoplake.plans import reliability_queries, itinerary_queries, place_queries, timetable_queries, line_queries, scalar_queries, article_queries, map_queries, station_queries  # noqa: F401, I001


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
