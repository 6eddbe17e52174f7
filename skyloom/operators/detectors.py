"""Change and onset detectors over daily series, as windows per seasonal year.

Every detector takes a long table (py, date, dopy, value) and gives one row per seasonal year. Sequential recursions are
written in their closed form over prefix windows, so they run on every year in parallel and need no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyloom.functions import columns as c


def year() -> WindowSpec:
    return Window.partitionBy("py")


def in_year() -> WindowSpec:
    return Window.partitionBy("py").orderBy("date")


def prefix() -> WindowSpec:
    return in_year().rowsBetween(Window.unboundedPreceding, 0)


def first_day(df: DataFrame, hit: Column, value: str = "dopy", name: str = "onset") -> DataFrame:
    """`value` of the first row of each year that is a hit; null where none is."""
    return df.groupBy("py").agg(F.min(F.when(hit, F.struct("date", value))).alias("_b")).select("py", F.col(f"_b.{value}").alias(name))


def sustained(x: str, sustain: int, least: int, ahead: Column, up: bool = True, eps: float = 0.005) -> Column:
    """The next `sustain` rows, this one included, hold at least `least` values, all on the right side of `ahead`."""
    frame = in_year().rowsBetween(0, sustain - 1)
    extreme = F.min(x).over(frame) >= ahead - eps if up else F.max(x).over(frame) <= ahead + eps
    return (F.count(F.lit(1)).over(frame) >= least) & (F.count(x).over(frame) >= least) & extreme


def crossing(df: DataFrame, x: str, threshold: Column, low: int, high: int, sustain: int = 15, least: int = 10, up: bool = True, eps: float = 0.005) -> DataFrame:
    """First sustained crossing: the row before is on the other side (it may lie outside the search window)."""
    before = F.lag(x).over(in_year())
    cross = (before < threshold) & (F.col(x) >= threshold) if up else (before > threshold) & (F.col(x) <= threshold)
    marked = df.withColumn("_hit", cross & F.col("dopy").between(low, high) & sustained(x, sustain, least, threshold, up, eps))
    return first_day(marked, F.col("_hit"))


def persistent(df: DataFrame, x: str, threshold: Column, low: int, high: int, sustain: int, least: int, up: bool = True, eps: float = 0.0) -> DataFrame:
    """First row at the threshold from which `least` of the next `sustain` rows stay within `eps` of it or beyond.

    No crossing is asked for; the first row of a year never counts.
    """
    now = F.col(x) >= threshold if up else F.col(x) <= threshold
    right = F.col(x) >= threshold - eps if up else F.col(x) <= threshold + eps
    frame = in_year().rowsBetween(0, sustain - 1)
    marked = df.withColumns({"_ok": F.when(F.col(x).isNotNull(), right.cast("int")), "_rn": F.row_number().over(in_year())})
    hit = now & (F.col("_rn") > 1) & F.col("dopy").between(low, high)
    marked = marked.withColumn("_hit", hit & (F.count("_ok").over(frame) >= least - 2) & (F.sum("_ok").over(frame) >= least))
    return first_day(marked, F.col("_hit"))


def cusum(df: DataFrame, x: str, slack: float = 0.5, limit: float = 3.0, start: int = 0) -> DataFrame:
    """Upper CUSUM of standardised steps: C = S - min(0, least prefix of S); mean and population deviation of the year."""
    z = df.where((F.col("dopy") >= start) & F.col(x).isNotNull()).withColumns({"_m": F.avg(x).over(year()), "_s": F.stddev_pop(x).over(year())})
    step = z.withColumn("_sum", F.sum(F.col(x) - F.col("_m") - slack * F.col("_s")).over(prefix()))
    up = step.withColumn("cusum", F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(prefix())))
    return first_day(up, (F.col("_s") > 1e-9) & (F.col("cusum") > limit * F.col("_s")))


def cusum_prewhitened(df: DataFrame, x: str, low: int = 60, high: int = 200, calm: int = 100, slack: float = 0.5, limit: float = 5.0, bound: float = 0.95, rows: int = 90, known: int = 80, quiet: int = 15) -> DataFrame:
    """CUSUM of AR(1) residuals within the search window: (py, last_zero, alarm), the day of the last zero before the alarm and the alarm's date.

    Gaps are interpolated by position. The coefficient is that of deviations from the window's mean on the ones before; mean and
    sample deviation of the residuals come from the days up to `calm`. Years of fewer than `rows` rows, `known` values or
    `quiet` calm residuals, or without spread, have none; without a zero before the alarm its first residual counts.
    """
    order = in_year()
    inside = df.where(F.col("dopy").between(low, high)).withColumns({"_i": F.row_number().over(order).cast("long"), "_rows": F.count("*").over(year()), "_known": F.count(x).over(year())})
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(x).isNotNull(), F.struct(F.col("_i").alias("n"), F.col(x).alias("v")))
    a, b = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(on)
    between = F.when(a["n"] == b["n"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["n"]) / (b["n"] - a["n"]))
    filled = inside.where((F.col("_rows") >= rows) & (F.col("_known") >= known)).withColumn("_u", F.coalesce(between, a["v"], b["v"]))
    r = filled.withColumn("_r", F.col("_u") - F.avg("_u").over(year())).withColumn("_p", F.lag("_r").over(order))
    square = F.sum(F.when(F.col("_p").isNotNull(), F.col("_p") * F.col("_p"))).over(year()) + 1e-9
    phi = F.least(F.greatest(F.sum(F.col("_p") * F.col("_r")).over(year()) / square, F.lit(-bound)), F.lit(bound))
    e = r.withColumn("_phi", phi).withColumn("_e", F.col("_r") - F.col("_phi") * F.col("_p")).where("_e is not null")
    base = F.when(F.col("dopy") <= calm, F.col("_e"))
    z = e.withColumns({"_m": F.avg(base).over(year()), "_s": F.stddev_samp(base).over(year()), "_k": F.count(base).over(year())}).where((F.col("_k") >= quiet) & (F.col("_s") >= 1e-6))
    s = z.withColumn("_sum", F.sum(F.col("_e") - F.col("_m") - slack * F.col("_s")).over(prefix()))
    up = s.withColumn("_c", F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(prefix())))
    alarm = up.withColumn("_alarm", F.min(F.when(F.col("_c") > limit * F.col("_s"), F.col("date"))).over(year()))
    found = alarm.groupBy("py").agg(
        F.max(F.when((F.col("date") < F.col("_alarm")) & (F.col("_c") < 1e-9), F.struct("date", "dopy"))).alias("_z"), F.min(F.struct("date", "dopy")).alias("_f"), F.max("_alarm").alias("alarm")
    )
    last = F.when(F.col("alarm").isNotNull(), F.coalesce(F.col("_z.dopy"), F.col("_f.dopy")))
    return df.select("py").distinct().join(found.select("py", last.alias("last_zero"), "alarm"), "py", "left")


def shiryaev_roberts(df: DataFrame, x: str, calm: int = 100, share: float = 0.5, cap: float = 300.0) -> DataFrame:
    """R = (1 + R) exp(l) as exp(L_t) * sum of exp(-L_(k-1)), in log space around the largest term; alarm at share * rows of the year."""
    quiet = F.when(F.col("dopy") <= calm, F.col(x))
    z = df.where(F.col(x).isNotNull()).withColumns({"_m": F.avg(quiet).over(year()), "_s": F.stddev_pop(quiet).over(year()), "_n": F.count("*").over(year())})
    llr = F.col("_s") * 0 + (F.col(x) - F.col("_m")) / F.col("_s") - 0.5
    L = z.where("_s > 1e-9").withColumn("_l", llr).withColumn("_cl", F.sum("_l").over(prefix()))
    before = L.withColumn("_before", F.col("_cl") - F.col("_l"))
    low = before.withColumn("_low", F.min("_before").over(year()))
    logr = F.col("_cl") - F.col("_low") + F.log(F.sum(F.exp(F.greatest(F.col("_low") - F.col("_before"), F.lit(-cap)))).over(prefix()))
    return first_day(low.withColumn("_r", logr), F.col("_r") >= F.log(share * F.col("_n")))


def pettitt(df: DataFrame, x: str) -> DataFrame:
    """Pettitt's test: average ranks, U = 2 * (sum of ranks) - t (n + 1), the first largest |U| and its p; no change beyond 0.05."""
    ranked = Window.partitionBy("py").orderBy(x)
    peers = Window.partitionBy("py", x)
    r = df.where(F.col(x).isNotNull()).withColumn("_r", F.rank().over(ranked) + (F.count("*").over(peers) - 1) / 2.0)
    u = r.withColumns({"_t": F.row_number().over(in_year()), "_n": F.count("*").over(year()), "_rs": F.sum("_r").over(prefix())})
    u = u.withColumn("_u", F.abs(2 * F.col("_rs") - F.col("_t") * (F.col("_n") + 1)))
    best = u.groupBy("py").agg(F.min(F.struct((-F.col("_u")).alias("k"), "date", "dopy", "_n")).alias("b"))
    p = 2 * F.exp(-6 * F.pow("b.k", 2) / (F.pow("b._n", 3) + F.pow("b._n", 2)))
    return best.select("py", c.rounded(-F.col("b.k"), 9).alias("k"), c.rounded(F.least(p, F.lit(1.0)), 9).alias("p"), F.when(p <= 0.05, F.col("b.dopy")).alias("onset"))


def rolling_slope(df: DataFrame, x: str, n: int, least: int) -> DataFrame:
    """Least-squares slope over n trailing rows with at least `least` values (it does not depend on where counting begins)."""
    frame = c.trailing(in_year(), n)
    numbered = df.withColumn("_rn", F.row_number().over(in_year()).cast("double"))
    return numbered.withColumn("slope", F.when(F.count(x).over(frame) >= least, F.regr_slope(x, "_rn").over(frame)))


def lanczos_kernel(length: int, cutoff: float) -> list[float]:
    """Windowed-sinc low-pass weights, normalised to one. `cutoff` in cycles per row."""
    import math

    half = length // 2
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    w = [2 * cutoff * sinc(2 * cutoff * k) * sinc(k / half) for k in range(-half, half + 1)]
    return [v / sum(w) for v in w]


def convolved(df: DataFrame, x: str, weights: list[float]) -> DataFrame:
    """Convolution of each year's rows with the weights; beyond the ends counts as zero, nothing is renormalised.

    The kernel is a small table; rows meet it by an equi-join on the shifted row number.
    """
    half = len(weights) // 2
    kernel = df.sparkSession.createDataFrame([(i - half, w) for i, w in enumerate(weights)], "off long, w double")
    rows = df.withColumn("_rn", F.row_number().over(in_year()).cast("long"))
    spread = rows.select("py", "_rn", F.col(x).alias("_x")).crossJoin(F.broadcast(kernel)).select("py", (F.col("_rn") + F.col("off")).alias("_rn"), (F.col("_x") * F.col("w")).alias("_y"))
    return rows.join(spread.groupBy("py", "_rn").agg(F.sum("_y").alias("low")), ["py", "_rn"])


def replicated_median(df: DataFrame, value: str = "onset", weight: str = "weight") -> DataFrame:
    """Median over methods, each value repeated round(10 * weight) times."""
    rep = F.explode(F.array_repeat(F.col(value), F.greatest(F.round(F.col(weight) * 10).cast("int"), F.lit(1))))
    return df.where(F.col(value).isNotNull()).select("py", rep.alias("v")).groupBy("py").agg(F.percentile("v", 0.5).alias("ensemble"), F.count("*").alias("votes"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, r and t; t is 0 for |r| below 1e-9 and null at |r| = 1."""
    g = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.regr_count(y, x).alias("n"))
    t = F.when(F.abs("r") < 1e-9, 0.0).when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    return g.select(c.rounded("slope", 9).alias("slope"), c.rounded("intercept", 9).alias("intercept"), c.rounded("r", 9).alias("r"), c.rounded(t, 9).alias("t"), "n")


def lag_correlation(df: DataFrame, x: str, y: str, most: int, least: int, order: str = "date") -> DataFrame:
    """Pearson r of x(t) and y(t + lag) by rows, for lags -most to most, with at least `least` pairs."""
    rn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))
    rows = df.withColumn("_rn", rn)
    lags = rows.select(F.col(x).alias("_x"), "_rn", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).select("_x", "lag", (F.col("_rn") + F.col("lag")).alias("_rn"))
    both = lags.join(rows.select("_rn", F.col(y).alias("_y")), "_rn").where("_x is not null and _y is not null")
    return both.groupBy(F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("r")).where(F.col("n") >= least)
