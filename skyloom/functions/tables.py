"""Table functions for SQL: the calibrated calendar of a year under a scenario, for LATERAL joins."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from skyloom.functions.columns import ANCHOR_DAY, ANCHOR_MONTH
from skyloom.operators.calendars import MANGSA, SCENARIOS

SCHEMA = "py bigint, scenario string, mangsa int, start date, stop date, days bigint"


def boundaries(starts: tuple[float, ...]) -> list[float]:
    """First seasonal day of each mangsa: within a season boundaries keep their traditional share, then the first again for the year after."""
    old = (0, 88, 183, 277, 365)
    ends = (*starts[1:], 365 + starts[0])
    out = []
    for no, *_, first in MANGSA:
        m = (no - 1) // 3
        out.append(starts[m] + (first - old[m]) / (old[m + 1] - old[m]) * (ends[m] - starts[m]))
    return out


def spans(py: int, scenario: str) -> Iterator[tuple]:
    """The twelve spans of a year; none for an unknown scenario or a null argument."""
    starts = next((s for key, s, *_ in SCENARIOS if key == scenario), None)
    if py is None or starts is None:
        return
    first = boundaries(starts)
    anchor = lambda year: datetime.date(year, ANCHOR_MONTH, ANCHOR_DAY)
    days = [anchor(py) + datetime.timedelta(days=round(f)) for f in first] + [anchor(py + 1) + datetime.timedelta(days=round(first[0]))]
    for k in range(12):
        yield py, scenario, MANGSA[k][0], days[k], days[k + 1] - datetime.timedelta(days=1), (days[k + 1] - days[k]).days


@udtf(returnType=SCHEMA)
class Calendar:
    """calendar(year, scenario): twelve rows."""

    def eval(self, py: int, scenario: str):
        yield from spans(py, scenario)


@udtf(returnType=SCHEMA)
class CalendarOf:
    """calendar_of(TABLE(t) PARTITION BY scenario ORDER BY py): the calendars of a table of (py, scenario), each year of a scenario once.

    Rows of a scenario come to one instance in the order of years, so a year that repeats is answered once without remembering all.
    """

    def __init__(self):
        self.last = None

    def eval(self, row):
        if row["py"] != self.last:
            self.last = row["py"]
            yield from spans(row["py"], row["scenario"])


def register(spark: SparkSession) -> None:
    """Make `calendar` and `calendar_of` known to the session's SQL."""
    spark.udtf.register("calendar", Calendar)
    spark.udtf.register("calendar_of", CalendarOf)
