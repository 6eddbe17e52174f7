"""Runs, transitions, extreme events and composites around events.

Windows without a partition are only ever put over series that have been aggregated to hours or days; anything raw is
partitioned or aggregated first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators.quantiles import percentiles, percentiles_long
from skyloom.operators.spacing import spaced


def along(time: str, keys: list[str] | None = None) -> WindowSpec:
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(time)


def run_lengths(df: DataFrame, value: str, time: str, keys: list[str]) -> DataFrame:
    """Runs of equal values in consecutive rows: keys, value, island and len."""
    change = F.when(F.col(value) == F.lag(value).over(along(time, keys)), 0).otherwise(1)
    marked = df.where(F.col(value).isNotNull()).withColumn("_new", change)
    return marked.withColumn("island", F.sum("_new").over(along(time, keys))).groupBy(*keys, value, "island").agg(F.count("*").alias("len"))


def transitions(df: DataFrame, value: str, time: str, keys: list[str], n: int) -> DataFrame:
    """Markov matrix in long form: every pair of the n classes, counts and row shares (0 for empty rows)."""
    spark = df.sparkSession
    pairs = df.where(F.col(value).isNotNull()).select(F.col(value).alias("from_sector"), F.lead(value).over(along(time, keys)).alias("to_sector")).where("to_sector is not null")
    counts = pairs.groupBy("from_sector", "to_sector").agg(F.count("*").alias("n"))
    one, two = spark.range(n).withColumnRenamed("id", "from_sector"), spark.range(n).withColumnRenamed("id", "to_sector")
    full = one.crossJoin(two).join(counts, ["from_sector", "to_sector"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("from_sector"))
    return full.select("from_sector", "to_sector", "n", c.rounded(F.when(total > 0, F.col("n") / total).otherwise(0.0)).alias("p"))


def percentile_table(df: DataFrame, fields: tuple[str, ...], qs: tuple[float, ...]) -> DataFrame:
    """Exact percentiles (linear interpolation) of several fields in two passes."""
    return percentiles_long(df, [], fields, list(qs), 1).select("field", "q", c.rounded("value").alias("x"))


def clusters(df: DataFrame, field: str, time: str, quantile: float, gap_hours: float) -> DataFrame:
    """Events: rows at or above the quantile, joined while the gap is at most `gap_hours`. The extremes are few; the window sees only them."""
    limit = percentiles(df, [], {"_thr": (field, quantile)}, 1)
    extreme = df.join(F.broadcast(limit), F.col(field) >= F.col("_thr"))
    apart = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(along(time)).cast("timestamp"))) / 3.6e9
    marked = extreme.withColumn("_apart", apart).withColumn("event", F.sum(F.when(F.col("_apart") <= gap_hours, 0).otherwise(1)).over(along(time).rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("event").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("n"), c.rounded(F.max(field)).alias("peak"), c.rounded(F.avg(field)).alias("mean")).drop("event")


def onset_candidates(df: DataFrame, field: str, time: str, dry: int = 6, wet: float = 0.5, dry_below: float = 0.1) -> DataFrame:
    """Rows above `wet` whose `dry` rows before are all below `dry_below`."""
    frame = along(time).rowsBetween(-dry, -1)
    marked = df.withColumns({"_before": F.max(field).over(frame), "_n": F.count(field).over(frame)})
    return marked.where((F.col(field) > wet) & (F.col("_n") == dry) & (F.col("_before") < dry_below)).drop("_before", "_n")


def onsets(df: DataFrame, field: str, time: str, keys: list[str], dry: int = 6, wet: float = 0.5, dry_below: float = 0.1, apart: int = 12) -> DataFrame:
    """Onset candidates of each place, thinned to those that a scan accepts: at least `apart` rows after the last one, and not in the last `apart` rows."""
    w = along(time, keys)
    frame = w.rowsBetween(-dry, -1)
    rows = df.withColumns({"rn": F.row_number().over(w), "_rest": F.count(F.lit(1)).over(w.rowsBetween(1, apart)), "_before": F.max(field).over(frame), "_n": F.count(field).over(frame)})
    found = rows.where((F.col(field) > wet) & (F.col("_n") == dry) & (F.col("_before") < dry_below) & (F.col("_rest") == apart))
    return spaced(found.drop("_before", "_n", "_rest"), apart, tuple(keys))


def superposed_epoch(df: DataFrame, events: DataFrame, time: str, fields: tuple[str, ...], reach: int) -> DataFrame:
    """Mean of each field at row offsets -reach to reach around the events: an equi-join on the shifted row number."""
    numbered = df.withColumn("rn", F.row_number().over(along(time)))
    at = numbered.join(events.select(time), time, "left_semi").select("rn")
    lags = at.select(F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"), "rn").select("lag", (F.col("rn") + F.col("lag")).alias("rn"))
    return lags.join(numbered, "rn").groupBy(F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), *[c.rounded(F.avg(f)).alias(f) for f in fields])
