"""All registered queries of the time-series and calendar library."""

from __future__ import annotations

from skyloom.plans import calendars, kernels, monsoon, observations, seasons, series, stations
from skyloom.plans.registry import QUERIES, SQL, Query

__all__ = ["calendars", "kernels", "monsoon", "observations", "oracle_sql", "queries", "seasons", "series", "stations"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
