"""Joins of intervals of days with intervals of days, by buckets of days: equi-joins, whatever their lengths and number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_number(date: str) -> Column:
    return F.unix_date(F.col(date))


def overlapping(left: DataFrame, right: DataFrame, width: int = 32, left_ends: tuple[str, str] = ("start", "stop"), right_ends: tuple[str, str] = ("low", "high"), on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose closed intervals of dates share a day (and whose `on` columns are equal), each once.

    Both sides are copied to the buckets of `width` days that they reach and meet there; a pair counts in the bucket in which the
    later of both begins. A day is an interval of one. Intervals with a null end meet nothing.
    """
    number = lambda d: F.floor(day_number(d) / width)

    def spread(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        whole = df.where(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull() & (F.col(ends[0]) <= F.col(ends[1])))
        return whole.withColumn("_bucket", F.explode(F.sequence(number(ends[0]), number(ends[1]))))

    a, b = spread(left, left_ends), spread(right, right_ends)
    pairs = a.join(b, ["_bucket", *on]).where((F.col(left_ends[0]) <= F.col(right_ends[1])) & (F.col(right_ends[0]) <= F.col(left_ends[1])))
    return pairs.where(F.col("_bucket") == F.floor(F.greatest(day_number(left_ends[0]), day_number(right_ends[0])) / width)).drop("_bucket")


def runs(df: DataFrame, active: str, number: str, date: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of active rows with consecutive numbers as intervals: keys, start, stop (dates), first and last (numbers).

    Consecutive numbers less their rank are equal within a run; the rank is among the active rows alone.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys, F.lit(1)).orderBy(number))
    marked = df.where(F.col(active)).withColumn("_run", F.col(number) - rank)
    return marked.groupBy(*keys, "_run").agg(F.min(date).alias("start"), F.max(date).alias("stop"), F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")
