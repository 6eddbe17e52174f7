"""Wind and weather aggregates: roses, matrices, profiles, gusts, regimes and exceedance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators.quantiles import with_percentiles

SPEED_EDGES = (0.0, 20.0, 40.0, 60.0, 80.0, 120.0, 200.0)
#: First seasonal day of each mangsa in the present normal, half-open, the last one wrapping; and the four seasons. Fixed values.
MANGSA_RANGES = (
    (1, 19.00, 53.94), (2, 53.94, 73.55), (3, 73.55, 94.00), (4, 94.00, 124.00), (5, 124.00, 156.40), (6, 156.40, 208.00),
    (7, 208.00, 243.68), (8, 243.68, 265.26), (9, 265.26, 286.00), (10, 286.00, 312.73), (11, 312.73, 338.34), (12, 338.34, 384.00),
)
MUSIM = (("Katiga", 1, 3), ("Labuh", 4, 6), ("Rendheng", 7, 9), ("Mareng", 10, 12))


def mangsa_of(day: str | Column) -> Column:
    """Number of the mangsa of a seasonal day in [0, 365)."""
    d = c.col(day)
    found = F.lit(12)
    for n, low, high in MANGSA_RANGES[:-1]:
        found = F.when((d >= low) & (d < high), n).otherwise(found)
    return F.when(d.isNotNull(), found).cast("long")


def musim_of(mangsa: str | Column) -> Column:
    found = F.lit(None).cast("string")
    for name, low, high in MUSIM:
        found = F.when(c.col(mangsa).between(low, high), name).otherwise(found)
    return found


def time_features(df: DataFrame, time: str = "time", direction: str = "wd") -> DataFrame:
    day = c.season_fraction(time)
    return df.withColumns({
        "hour": F.hour(time).cast("long"), "month": F.month(time).cast("long"), "year": F.year(time).cast("long"), "dopy": day,
        "mangsa": mangsa_of(day), "u": c.wind_u(direction), "v": c.wind_v(direction),
    })


def wind_rose(df: DataFrame, sectors: int = 16, edges: tuple[float, ...] = SPEED_EDGES, by: tuple[str, ...] = ()) -> DataFrame:
    """Share (percent of valid rows, within `by`) and count for each sector and speed bin that occurs.

    Counts are combined before the one shuffle, and shares come from the few groups.
    """
    from pyspark.sql import Window

    valid = df.where(F.col("ws").isNotNull() & F.col("wd").isNotNull())
    counts = valid.groupBy(*by, c.sector("wd", sectors).alias("sector"), c.left_closed_bin("ws", edges).alias("bin")).agg(F.count("*").alias("n"), F.sum("ws").alias("_s"))
    total = F.sum("n").over(Window.partitionBy(*[F.col(b) for b in by]) if by else Window.partitionBy(F.lit(1)))
    return counts.select(*by, "sector", "bin", "n", (100.0 * F.col("n") / total).alias("pct"), (F.col("_s") / F.col("n")).alias("mean_ws"))


def direction_summary() -> list[Column]:
    return [F.count("wd").alias("n"), c.rounded(c.circular_mean("wd")).alias("mean_dir"), c.rounded(c.resultant_length("wd")).alias("r"), c.rounded(c.circular_std("wd")).alias("sd_dir")]


def percentile_names(x: str, *ps: float) -> dict[str, tuple[str, float]]:
    return {f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}": (x, p) for p in ps}


def with_speed_percentiles(rows: DataFrame, summary: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], groups: int) -> DataFrame:
    """`summary` with exact percentiles by linear interpolation, rounded."""
    out = with_percentiles(rows, summary, keys, wanted, groups)
    return out.withColumns({n: c.rounded(n) for n in wanted})


def monthly_stats(df: DataFrame) -> DataFrame:
    rows = df.withColumn("month", F.month("time").cast("long"))
    stats = rows.groupBy("month").agg(*direction_summary(), c.rounded(F.avg("ws")).alias("mean"), c.rounded(F.max("ws")).alias("max"), c.rounded(F.max("gust")).alias("max_gust"))
    return with_speed_percentiles(rows, stats, ["month"], percentile_names("ws", 0.1, 0.5, 0.9), 13)


def mangsa_profile(df: DataFrame) -> DataFrame:
    """All twelve mangsa, with nulls where none of the rows falls."""
    spark = df.sparkSession
    rows = time_features(df)
    own = rows.groupBy("mangsa").agg(*direction_summary(), c.rounded(F.avg("ws")).alias("mean"))
    own = with_speed_percentiles(rows, own, ["mangsa"], percentile_names("ws", 0.5, 0.9), 13)
    keys = spark.range(1, 13).select(F.col("id").alias("mangsa"))
    return keys.join(own, "mangsa", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gust_stats(df: DataFrame) -> DataFrame:
    valid = df.where((F.col("ws") >= 1) & F.col("gust").isNotNull()).withColumn("gf", F.col("gust") / F.col("ws"))
    return with_speed_percentiles(valid, valid.agg(F.count("*").alias("n"), c.rounded(F.avg("gf")).alias("mean")), [], percentile_names("gf", 0.5, 0.9, 0.99), 1)


def exceedance(df: DataFrame, fields: tuple[str, ...], thresholds: tuple[float, ...]) -> DataFrame:
    """field, threshold, count and percent of values at or above each threshold, in one pass over the rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in fields])).alias("p")).select("p.*").where("x is not null")
    counts = long.groupBy("field").agg(F.count("*").alias("n"), *[F.count_if(F.col("x") >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("hits")) for i, t in enumerate(thresholds)])
    return counts.select("field", "n", F.explode(rows).alias("r")).select("field", "r.threshold", "r.hits", c.rounded(100.0 * F.col("r.hits") / F.col("n")).alias("pct"))


def histogram(df: DataFrame, x: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts of equal bins, the last one closed on the right; values outside are left out."""
    high = low + bins * width
    valid = df.where(F.col(x).between(low, high))
    return valid.groupBy(F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def unpivoted(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("p")).select(*keys, "p.field", "p.x")
