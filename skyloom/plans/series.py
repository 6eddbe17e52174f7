"""Queries over daily series: rolls, fills, indices, detectors, trends, sets and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators import detectors as det
from skyloom.plans.registry import query
from skyloom.sources import surrogate as s


def r9(x: str) -> str:
    return f"round({x}, 9) + 0.0"


def r9c(x):
    return c.rounded(x, 9)


def by_date():
    """Rows in order of date. One partition is right here: the series have been aggregated to days before."""
    return Window.partitionBy(F.lit(1)).orderBy("date")


def rolled(name: str, n: int, kind: str) -> None:
    back, ahead = (n - 1 - (n - 1) // 2, (n - 1) // 2) if kind == "centered" else (n - 1, 0)
    least = n // 2
    frame = f"(ORDER BY date ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"

    @query(name, f"SELECT date, CASE WHEN count(v) OVER {frame} >= {least} THEN round(avg(v) OVER {frame}, 9) END AS roll FROM daily", "daily")
    def q(spark, d):
        w = c.centered(by_date(), n) if kind == "centered" else c.trailing(by_date(), n)
        return s.daily(spark, d).select("date", F.round(c.rolling(F.avg, "v", w, least), 9).alias("roll"))


for _n in (7, 14, 21, 30):
    rolled(f"rolling_centered_{_n}", _n, "centered")
rolled("rolling_trailing_30", 30, "trailing")


@query("rolling_fraction", "SELECT date, round(avg(CASE WHEN v > 140 THEN 1.0 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 9) AS share FROM daily", "daily")
def rolling_fraction(spark, d):
    return s.daily(spark, d).select("date", r9c(F.avg(F.when(F.col("v") > 140, 1.0).otherwise(0.0)).over(c.trailing(by_date(), 14))).alias("share"))


@query("dopy_features", "SELECT date, py, dopy, CAST(CASE WHEN dopy >= 80 AND dopy < 130 THEN 1 WHEN dopy >= 130 AND dopy < 180 THEN 2 WHEN dopy >= 180 AND dopy < 250 THEN 3 WHEN dopy >= 250 AND dopy < 310 THEN 4 ELSE 5 END AS BIGINT) AS phase FROM daily", "daily")
def dopy_features(spark, d):
    return s.daily(spark, d).select("date", "py", "dopy", c.phase("dopy").alias("phase"))


@query("pranata_year", "SELECT py, count(*) AS n, min(date) AS first, max(date) AS last, CAST(max(date - make_date(CAST(py AS INT), 6, 22)) AS BIGINT) AS last_day FROM daily GROUP BY 1", "daily")
def pranata_year(spark, d):
    return s.daily(spark, d).groupBy("py").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.max(c.season_day("date")).alias("last_day"))


@query("phase_composite", f"SELECT CAST(CASE WHEN dopy >= 80 AND dopy < 130 THEN 1 WHEN dopy >= 130 AND dopy < 180 THEN 2 WHEN dopy >= 180 AND dopy < 250 THEN 3 WHEN dopy >= 250 AND dopy < 310 THEN 4 ELSE 5 END AS BIGINT) AS phase, count(*) AS n, CASE WHEN count(*) >= 10 THEN {r9('avg(v)')} END AS mean, CASE WHEN count(*) >= 10 THEN {r9('24 * avg(n)')} END AS per_day FROM daily GROUP BY 1", "daily")
def phase_composite(spark, d):
    enough = F.count("*") >= 10
    return s.daily(spark, d).groupBy(c.phase("dopy").alias("phase")).agg(F.count("*").alias("n"), F.when(enough, r9c(F.avg("v"))).alias("mean"), F.when(enough, r9c(24 * F.avg("n"))).alias("per_day"))


@query("five_day_bins", f"SELECT dopy // 5 * 5 AS bin, count(*) AS n, {r9('avg(v)')} AS mean FROM daily GROUP BY 1", "daily")
def five_day_bins(spark, d):
    return s.daily(spark, d).groupBy((F.floor(F.col("dopy") / 5) * 5).alias("bin")).agg(F.count("*").alias("n"), r9c(F.avg("v")).alias("mean"))


@query("daily_aggregate_min20", f"SELECT CAST(hour AS DATE) AS date, count(*) AS hours, {r9('avg(ws)')} AS mean, {r9('max(gust)')} AS gust, {r9('coalesce(sum(precip), 0)')} AS precip, {r9('stddev_samp(ws)')} AS sd, {r9('avg(CASE WHEN hour(hour) BETWEEN 12 AND 16 THEN cloud END)')} AS cloud_pm FROM series GROUP BY 1 HAVING count(*) >= 20", "series")
def daily_aggregate_min20(spark, d):
    g = s.series(spark, d).groupBy(F.to_date("hour").alias("date")).agg(
        F.count("*").alias("hours"), r9c(F.avg("ws")).alias("mean"), r9c(F.max("gust")).alias("gust"), r9c(F.coalesce(F.sum("precip"), F.lit(0.0))).alias("precip"), r9c(F.stddev_samp("ws")).alias("sd"), r9c(F.avg(F.when(F.hour("hour").between(12, 16), F.col("cloud")))).alias("cloud_pm")
    )
    return g.where("hours >= 20")


@query("monthly_anomaly", "SELECT date, round(v - avg(v) OVER (PARTITION BY month(date)), 9) AS anomaly FROM daily", "daily")
def monthly_anomaly(spark, d):
    return s.daily(spark, d).select("date", F.round(F.col("v") - F.avg("v").over(Window.partitionBy(F.month("date"))), 9).alias("anomaly"))


@query("morning_afternoon_join", f"""WITH m AS (SELECT CAST(hour AS DATE) AS date, avg(ws) AS am, count(*) AS k FROM series WHERE hour(hour) BETWEEN 6 AND 9 GROUP BY 1 HAVING count(*) >= 3), a AS (SELECT CAST(hour AS DATE) AS date, max(ws) AS pm FROM series WHERE hour(hour) BETWEEN 12 AND 16 GROUP BY 1 HAVING count(*) >= 3)
SELECT m.date, {r9('am')} AS am, {r9('pm')} AS pm FROM m JOIN a USING (date)""", "series")
def morning_afternoon_join(spark, d):
    x = s.series(spark, d).withColumns({"date": F.to_date("hour"), "h": F.hour("hour")})
    am = x.where(F.col("h").between(6, 9)).groupBy("date").agg(F.avg("ws").alias("am"), F.count("*").alias("k")).where("k >= 3").drop("k")
    pm = x.where(F.col("h").between(12, 16)).groupBy("date").agg(F.max("ws").alias("pm"), F.count("*").alias("k")).where("k >= 3").drop("k")
    return am.join(pm, "date").select("date", r9c("am").alias("am"), r9c("pm").alias("pm"))


@query("contingency_lift", f"""WITH x AS (SELECT daily.date, v, w FROM daily JOIN daily2 USING (date)), q AS (SELECT quantile_cont(v, 0.9) AS a, quantile_cont(w, 0.75) AS b FROM x)
SELECT count(*) AS n, {r9('avg(CASE WHEN v >= a THEN 1.0 ELSE 0 END)')} AS base, count(*) FILTER (w >= b) AS n_cond, CASE WHEN count(*) FILTER (w >= b) >= 30 THEN {r9('avg(CASE WHEN v >= a THEN 1.0 ELSE 0 END) FILTER (w >= b) / avg(CASE WHEN v >= a THEN 1.0 ELSE 0 END)')} END AS lift FROM x, q""", "daily", "daily2")
def contingency_lift(spark, d):
    x = s.daily(spark, d).join(s.daily2(spark, d), "date")
    q = x.agg(F.percentile("v", 0.9).alias("a"), F.percentile("w", 0.75).alias("b"))
    y = x.crossJoin(F.broadcast(q)).select(F.when(F.col("v") >= F.col("a"), 1.0).otherwise(0.0).alias("e"), (F.col("w") >= F.col("b")).alias("k"))
    g = y.agg(F.count("*").alias("n"), F.avg("e").alias("base"), F.count_if("k").alias("n_cond"), F.avg(F.when(F.col("k"), F.col("e"))).alias("p"))
    return g.select("n", r9c("base").alias("base"), "n_cond", F.when(F.col("n_cond") >= 30, r9c(F.col("p") / F.col("base"))).alias("lift"))


@query("event_composite", f"""WITH q AS (SELECT quantile_cont(v, 0.95) AS a FROM daily) SELECT v >= a AS event, count(*) AS n, {r9('avg(v)')} AS mean, {r9('avg(n)')} AS mean_n, {r9('quantile_cont(v, 0.5)')} AS p50 FROM daily, q GROUP BY 1""", "daily")
def event_composite(spark, d):
    x = s.daily(spark, d)
    q = x.agg(F.percentile("v", 0.95).alias("a"))
    return x.crossJoin(F.broadcast(q)).groupBy((F.col("v") >= F.col("a")).alias("event")).agg(F.count("*").alias("n"), r9c(F.avg("v")).alias("mean"), r9c(F.avg("n")).alias("mean_n"), r9c(F.percentile("v", 0.5)).alias("p50"))


GAPPY = "g AS (SELECT date, CASE WHEN dopy % 7 < 2 THEN NULL ELSE v END AS x, row_number() OVER (ORDER BY date) AS rn FROM daily)"


def gappy(spark, d):
    return s.daily(spark, d).select("date", F.when(F.col("dopy") % 7 >= 2, F.col("v")).alias("x"), F.row_number().over(by_date()).alias("rn"))


@query("ffill_bfill", f"WITH {GAPPY} SELECT date, round(coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS filled FROM g", "daily")
def ffill_bfill(spark, d):
    return gappy(spark, d).select("date", F.round(F.coalesce(c.forward_fill("x", by_date()), c.back_fill("x", by_date())), 9).alias("filled"))


@query("linear_interpolate", f"""WITH {GAPPY}, b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS r0, last_value(x IGNORE NULLS) OVER p AS x0, first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS r1, first_value(x IGNORE NULLS) OVER f AS x1
  FROM g WINDOW p AS (ORDER BY date ROWS UNBOUNDED PRECEDING), f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT date, round(CASE WHEN x IS NOT NULL THEN x WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (rn - r0) / (r1 - r0) END, 9) AS filled FROM b""", "daily")
def linear_interpolate(spark, d):
    g = gappy(spark, d).withColumn("k", F.when(F.col("x").isNotNull(), F.col("rn")))
    b = g.withColumns({"r0": c.forward_fill("k", by_date()), "x0": c.forward_fill("x", by_date()), "r1": c.back_fill("k", by_date()), "x1": c.back_fill("x", by_date())})
    line = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("rn") - F.col("r0")) / (F.col("r1") - F.col("r0"))
    return b.select("date", F.round(F.when(F.col("x").isNotNull(), F.col("x")).when(F.col("x0").isNull(), F.col("x1")).when(F.col("x1").isNull(), F.col("x0")).otherwise(line), 9).alias("filled"))


@query("lag_correlation", f"""WITH x AS (SELECT daily.date, v, w, row_number() OVER (ORDER BY daily.date) AS rn FROM daily JOIN daily2 USING (date))
SELECT l.lag, count(*) AS n, {r9('corr(a.v, b.w)')} AS r FROM (SELECT unnest(generate_series(-14, 14)) AS lag) l, x a JOIN x b ON b.rn = a.rn + l.lag GROUP BY 1 HAVING count(*) >= 50""", "daily", "daily2")
def lag_correlation(spark, d):
    x = s.daily(spark, d).join(s.daily2(spark, d), "date")
    return det.lag_correlation(x, "v", "w", 14, 50).select("lag", "n", r9c("r").alias("r"))


@query("autocorrelation", f"""WITH x AS (SELECT v, row_number() OVER (ORDER BY date) AS rn FROM daily) SELECT l.lag, count(*) AS n, {r9('corr(a.v, b.v)')} AS r FROM (SELECT unnest([1, 2, 3, 6, 12, 18, 24]::BIGINT[]) AS lag) l, x a JOIN x b ON b.rn = a.rn + l.lag GROUP BY 1""", "daily")
def autocorrelation(spark, d):
    return det.lag_correlation(s.daily(spark, d), "v", "v", 24, 1).where(F.col("lag").isin(1, 2, 3, 6, 12, 18, 24)).select("lag", "n", r9c("r").alias("r"))


INDEX = """z AS (SELECT date, py, dopy, (v - avg(v) OVER p) / stddev_samp(v) OVER p AS z1, (n - avg(n) OVER p) / nullif(stddev_samp(n) OVER p, 0) AS z2 FROM daily WINDOW p AS (PARTITION BY py)),
i AS (SELECT *, coalesce((2.5 * z1 + 1.5 * z2) / 4, z1, z2) AS idx FROM z), rr AS (SELECT *, avg(idx) OVER (PARTITION BY py ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS roll FROM i)"""


def index(spark, d):
    """Weighted mean of standardised fields per seasonal year, rescaled where a field is missing, and its centred roll."""
    x = s.daily(spark, d)
    w = det.year()
    z = x.withColumns({"z1": c.zscore("v", w), "z2": c.zscore("n", w)})
    i = z.withColumn("idx", F.coalesce((2.5 * F.col("z1") + 1.5 * F.col("z2")) / 4, F.col("z1"), F.col("z2")))
    return i.withColumn("roll", F.avg("idx").over(c.centered(det.in_year(), 21)))


@query("zscore_index", f"WITH {INDEX} SELECT date, round(idx, 9) AS idx, round(roll, 9) AS roll FROM rr", "daily")
def zscore_index(spark, d):
    return index(spark, d).select("date", F.round("idx", 9).alias("idx"), F.round("roll", 9).alias("roll"))


@query("crossing_sustained", f"""WITH {INDEX}, x AS (SELECT *, lag(roll) OVER w AS prev, min(roll) OVER f AS low, count(roll) OVER f AS k FROM rr WINDOW w AS (PARTITION BY py ORDER BY date), f AS (PARTITION BY py ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT py, (min((date, dopy)) FILTER (prev < 0.05 AND roll >= 0.05 AND dopy BETWEEN 30 AND 330 AND k >= 4 AND low >= 0.05 - 0.005))[2] AS onset FROM x GROUP BY 1""".replace("[2]", "").replace("(min((date, dopy))", "arg_min(dopy, date)").replace("low >= 0.05 - 0.005))", "low >= 0.05 - 0.005)"), "daily")
def crossing_sustained(spark, d):
    return det.crossing(index(spark, d), "roll", F.lit(0.05), 30, 330, sustain=6, least=4)


@query("crossing_persistent", f"""WITH {INDEX}, x AS (SELECT *, sum(CASE WHEN roll >= 0.05 THEN 1 ELSE 0 END) OVER f AS ok, count(roll) OVER f AS k, row_number() OVER (PARTITION BY py ORDER BY date) AS rn FROM rr WINDOW f AS (PARTITION BY py ORDER BY date ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT py, arg_min(dopy, date) FILTER (roll >= 0.05 AND rn > 1 AND dopy BETWEEN 100 AND 195 AND k >= 6 AND ok >= 8) AS onset FROM x GROUP BY 1""", "daily")
def crossing_persistent(spark, d):
    return det.persistent(index(spark, d), "roll", F.lit(0.05), 100, 195, 10, 8)


@query("dry_season_threshold", f"""WITH {INDEX} SELECT py, round(CASE WHEN count(roll) FILTER (dopy BETWEEN 50 AND 130) >= 5 THEN avg(roll) FILTER (dopy BETWEEN 50 AND 130) + 1.5 * stddev_samp(roll) FILTER (dopy BETWEEN 50 AND 130) ELSE 0.25 END, 9) AS threshold,
  round(CASE WHEN count(roll) FILTER (dopy BETWEEN 50 AND 130) >= 5 THEN median(roll) FILTER (dopy BETWEEN 50 AND 130) ELSE median(roll) END, 9) AS dry FROM rr GROUP BY 1""", "daily")
def dry_season_threshold(spark, d):
    dry = F.when(F.col("dopy").between(50, 130), F.col("roll"))
    return index(spark, d).groupBy("py").agg(
        F.round(F.when(F.count(dry) >= 5, F.avg(dry) + 1.5 * F.stddev_samp(dry)).otherwise(0.25), 9).alias("threshold"), F.round(F.when(F.count(dry) >= 5, F.percentile(dry, 0.5)).otherwise(F.percentile("roll", 0.5)), 9).alias("dry")
    )


@query("joint_signal", f"""WITH x AS (SELECT py, dopy, daily.date, CASE WHEN v IS NULL OR w IS NULL THEN NULL ELSE CAST((v > 140)::INT + (w > 38)::INT AS DOUBLE) END AS score FROM daily LEFT JOIN daily2 USING (date)),
y AS (SELECT *, avg(score) OVER (PARTITION BY py ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS m FROM x) SELECT py, arg_min(dopy, date) FILTER (m >= 1.2 AND dopy BETWEEN 90 AND 220) AS onset, {r9('max(m)')} AS peak FROM y GROUP BY 1""", "daily", "daily2")
def joint_signal(spark, d):
    """Score of conditions met, null if one is unknown, its 14-row mean, and the first day at the level."""
    x = s.daily(spark, d).join(s.daily2(spark, d), "date", "left")
    score = F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), (F.col("v") > 140).cast("double") + (F.col("w") > 38).cast("double"))
    y = x.withColumn("score", score).withColumn("m", F.avg("score").over(c.trailing(det.in_year(), 14)))
    hit = (F.col("m") >= 1.2) & F.col("dopy").between(90, 220)
    return y.groupBy("py").agg(F.min(F.when(hit, F.struct("date", "dopy"))).alias("b"), r9c(F.max("m")).alias("peak")).select("py", F.col("b.dopy").alias("onset"), "peak")


@query("pettitt", f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY py ORDER BY v) + (count(*) OVER (PARTITION BY py, v) - 1) / 2.0 AS r FROM daily), u AS (SELECT *, abs(2 * sum(r) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING) - row_number() OVER (PARTITION BY py ORDER BY date) * (count(*) OVER (PARTITION BY py) + 1)) AS u, count(*) OVER (PARTITION BY py) AS k FROM r),
b AS (SELECT py, max(u) AS k, any_value(k) AS n, arg_min(dopy, (-u, date)) AS dopy FROM u GROUP BY 1) SELECT py, {r9('k')} AS k, {r9('least(2 * exp(-6 * pow(k, 2) / (pow(n, 3) + pow(n, 2))), 1.0)')} AS p, CASE WHEN 2 * exp(-6 * pow(k, 2) / (pow(n, 3) + pow(n, 2))) <= 0.05 THEN dopy END AS onset FROM b""", "daily")
def pettitt(spark, d):
    return det.pettitt(s.daily(spark, d), "v")


@query("cusum", """WITH z AS (SELECT *, avg(v) OVER p AS m, stddev_pop(v) OVER p AS sd FROM daily WHERE dopy >= 90 WINDOW p AS (PARTITION BY py)), y AS (SELECT *, sum(v - m - 0.25 * sd) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING) AS cs FROM z),
x AS (SELECT *, cs - least(0, min(cs) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING)) AS up FROM y) SELECT py, arg_min(dopy, date) FILTER (sd > 1e-9 AND up > 3 * sd) AS onset FROM x GROUP BY 1""", "daily")
def cusum(spark, d):
    return det.cusum(s.daily(spark, d), "v", slack=0.25, start=90)


@query("cusum_ar1", """WITH i AS (SELECT py, date, dopy, u_comp AS x, row_number() OVER (PARTITION BY py ORDER BY date) AS i, count(*) OVER (PARTITION BY py) AS k FROM climate WHERE dopy BETWEEN 60 AND 200), f AS (SELECT *, x - avg(x) OVER (PARTITION BY py) AS r FROM i WHERE k >= 90),
l AS (SELECT *, lag(r) OVER (PARTITION BY py ORDER BY date) AS p FROM f), g AS (SELECT *, least(greatest(sum(p * r) OVER (PARTITION BY py) / (sum(p * p) OVER (PARTITION BY py) + 1e-9), -0.95), 0.95) AS phi FROM l), e AS (SELECT *, r - phi * p AS e FROM g WHERE p IS NOT NULL),
z AS (SELECT *, avg(CASE WHEN dopy <= 100 THEN e END) OVER w AS m, stddev_samp(CASE WHEN dopy <= 100 THEN e END) OVER w AS sd, count(CASE WHEN dopy <= 100 THEN e END) OVER w AS q FROM e WINDOW w AS (PARTITION BY py)),
y AS (SELECT *, sum(e - m - 0.5 * sd) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING) AS cs FROM z WHERE q >= 15 AND sd >= 1e-6), x AS (SELECT *, cs - least(0, min(cs) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING)) AS up FROM y),
a AS (SELECT *, min(CASE WHEN up > 5 * sd THEN date END) OVER (PARTITION BY py) AS alarm FROM x), o AS (SELECT py, coalesce(arg_max(dopy, date) FILTER (date < alarm AND up < 1e-9), arg_min(dopy, date)) AS lz, max(alarm) AS alarm FROM a GROUP BY 1)
SELECT d.py, CASE WHEN alarm IS NOT NULL THEN lz END AS last_zero, alarm FROM (SELECT DISTINCT py FROM climate) d LEFT JOIN o USING (py)""", "climate")
def cusum_ar1(spark, d):
    return det.cusum_prewhitened(s.climate(spark, d), "u_comp")


@query("shiryaev_roberts", """WITH z AS (SELECT *, avg(CASE WHEN dopy <= 100 THEN v END) OVER p AS m, stddev_pop(CASE WHEN dopy <= 100 THEN v END) OVER p AS sd, count(*) OVER p AS k FROM daily WINDOW p AS (PARTITION BY py)), l AS (SELECT *, (v - m) / sd - 0.5 AS l FROM z WHERE sd > 1e-9),
c AS (SELECT *, sum(l) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING) AS cl FROM l), b AS (SELECT *, min(cl - l) OVER (PARTITION BY py) AS low FROM c),
r AS (SELECT *, cl - low + ln(sum(exp(greatest(low - (cl - l), -300))) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING)) AS lr FROM b) SELECT py, arg_min(dopy, date) FILTER (lr >= ln(0.5 * k)) AS onset FROM r GROUP BY 1""", "daily")
def shiryaev_roberts(spark, d):
    return det.shiryaev_roberts(s.daily(spark, d), "v")


@query("rolling_slope", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY py ORDER BY date)::DOUBLE AS rn FROM daily) SELECT date, CASE WHEN count(v) OVER f >= 4 THEN round(regr_slope(v, rn) OVER f, 4) + 0.0 END AS slope FROM x WINDOW f AS (PARTITION BY py ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", "daily")
def rolling_slope(spark, d):
    return det.rolling_slope(s.daily(spark, d), "v", 7, 4).select("date", (F.round("slope", 4) + 0.0).alias("slope"))


_K = det.lanczos_kernel(31, 1 / 10)


@query("lanczos", "WITH k AS (SELECT unnest(generate_series(-15, 15)) AS off, unnest([" + ", ".join(f"{w!r}::DOUBLE" for w in _K) + "]) AS w), r AS (SELECT *, row_number() OVER (PARTITION BY py ORDER BY date) AS rn FROM daily) SELECT a.date, round(sum(b.v * k.w), 9) AS low FROM r a JOIN k ON true JOIN r b ON b.py = a.py AND b.rn = a.rn - k.off GROUP BY 1", "daily")
def lanczos(spark, d):
    return det.convolved(s.daily(spark, d), "v", _K).select("date", F.round("low", 9).alias("low"))


@query("replicated_median", """WITH m AS (SELECT py, unnest([min(dopy), max(dopy), CAST(median(dopy) AS BIGINT)]) AS v, unnest([1.0, 0.5, 1.5]) AS w FROM daily GROUP BY 1), e AS (SELECT py, v, unnest(generate_series(1, CAST(round(w * 10) AS INT))) FROM m) SELECT py, median(v) AS ensemble, count(*) AS votes FROM e GROUP BY 1""", "daily")
def replicated_median(spark, d):
    m = s.daily(spark, d).groupBy("py").agg(F.min("dopy").alias("a"), F.max("dopy").alias("b"), F.bround(F.percentile("dopy", 0.5), 0).cast("long").alias("c"))
    rows = F.array(*[F.struct(F.col(k).alias("onset"), F.lit(w).alias("weight")) for k, w in (("a", 1.0), ("b", 0.5), ("c", 1.5))])
    return det.replicated_median(m.select("py", F.explode(rows).alias("r")).select("py", "r.*"))


@query("linear_trend", f"WITH g AS (SELECT regr_slope(y, py) AS slope, regr_intercept(y, py) AS i, corr(y, py) AS r, regr_count(y, py) AS n FROM (SELECT py, avg(v) AS y FROM daily GROUP BY 1)) SELECT {r9('slope')} AS slope, round(i, 4) AS intercept, {r9('r')} AS r, {r9('r * sqrt((n - 2) / (1 - r * r))')} AS t, CAST(n AS BIGINT) AS n FROM g", "daily")
def linear_trend(spark, d):
    y = s.daily(spark, d).groupBy("py").agg(F.avg("v").alias("y"))
    return det.linear_trend(y, "py", "y").withColumn("intercept", F.round("intercept", 4))


@query("outlier_screen", f"WITH y AS (SELECT py, avg(v) AS y FROM daily GROUP BY 1), z AS (SELECT *, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS z FROM y) SELECT py, round(y, 9) AS y, round(z, 9) AS z, abs(z) < 2 AS inlier, round(avg(CASE WHEN abs(z) < 2 THEN y END) OVER (), 9) AS robust FROM z", "daily")
def outlier_screen(spark, d):
    w = Window.partitionBy(F.lit(1))
    z = s.daily(spark, d).groupBy("py").agg(F.avg("v").alias("y")).withColumn("z", c.zscore("y", w))
    inlier = F.abs("z") < 2
    return z.select("py", F.round("y", 9).alias("y"), F.round("z", 9).alias("z"), inlier.alias("inlier"), F.round(F.avg(F.when(inlier, F.col("y"))).over(w), 9).alias("robust"))


@query("welch_t", f"WITH g AS (SELECT py % 2 AS k, avg(v) AS m, var_samp(v) AS s, count(*) AS n FROM daily GROUP BY 1) SELECT {r9('(a.m - b.m) / sqrt(a.s / a.n + b.s / b.n)')} AS t, {r9('pow(a.s / a.n + b.s / b.n, 2) / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1))')} AS df FROM g a, g b WHERE a.k = 0 AND b.k = 1", "daily")
def welch_t(spark, d):
    """t of unequal variances and its degrees of freedom for two groups of years, from one aggregate."""
    g = s.daily(spark, d).agg(*[f(F.when(F.col("py") % 2 == k, F.col("v"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))])
    a, b = F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")
    return g.select(r9c((F.col("m0") - F.col("m1")) / F.sqrt(a + b)).alias("t"), r9c(F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n0") - 1) + F.pow(b, 2) / (F.col("n1") - 1))).alias("df"))


@query("interannual_stats", f"SELECT year(date) AS year, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(quantile_cont(v, 0.9), 9) AS p90 FROM daily GROUP BY 1 HAVING count(*) >= 100", "daily")
def interannual_stats(spark, d):
    return s.daily(spark, d).groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v"), 9).alias("sd"), F.round(F.percentile("v", 0.9), 9).alias("p90")).where("n >= 100")


@query("multiyear_stats", f"""WITH y AS (SELECT py, avg(v) AS mean, max(v) AS top FROM daily GROUP BY 1), l AS (UNPIVOT y ON mean, top INTO NAME metric VALUE x), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY py) - 1 AS i FROM l)
SELECT metric, count(*) AS n, round(avg(x), 9) AS mean, round(median(x), 9) AS median, round(stddev_samp(x), 9) AS sd, round(min(x), 9) AS min, round(max(x), 9) AS max, round(regr_slope(x, i), 9) AS trend FROM r GROUP BY 1""", "daily")
def multiyear_stats(spark, d):
    """Statistics over years; the trend is over the number of the record, not the year."""
    y = s.daily(spark, d).groupBy("py").agg(F.avg("v").alias("mean"), F.max("v").alias("top"))
    long = y.select("py", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("x")) for k in ("mean", "top")])).alias("r")).select("py", "r.*")
    i = long.withColumn("i", (F.row_number().over(Window.partitionBy("metric").orderBy("py")) - 1).cast("double"))
    r5 = lambda x: F.round(x, 9)
    return i.groupBy("metric").agg(F.count("*").alias("n"), r5(F.avg("x")).alias("mean"), r5(F.percentile("x", 0.5)).alias("median"), r5(F.stddev_samp("x")).alias("sd"), r5(F.min("x")).alias("min"), r5(F.max("x")).alias("max"), r5(F.regr_slope("x", "i")).alias("trend"))


@query("precip_partition", f"""WITH y AS (SELECT py, count(*) AS k, sum(v) AS total, sum(CASE WHEN dopy BETWEEN 100 AND 300 THEN v END) AS wet FROM daily GROUP BY 1 HAVING count(*) >= 100) SELECT count(*) AS years, round(avg(total), 4) AS total, round(avg(wet), 4) AS wet, {r9('avg(wet / total)')} AS share FROM y""", "daily")
def precip_partition(spark, d):
    wet = F.sum(F.when(F.col("dopy").between(100, 300), F.col("v")))
    y = s.daily(spark, d).groupBy("py").agg(F.count("*").alias("k"), F.sum("v").alias("total"), wet.alias("wet")).where("k >= 100")
    return y.agg(F.count("*").alias("years"), F.round(F.avg("total"), 4).alias("total"), F.round(F.avg("wet"), 4).alias("wet"), r9c(F.avg(F.col("wet") / F.col("total"))).alias("share"))


@query("window_stats", f"""WITH w(name, a, b) AS (VALUES ('onset', 90, 150), ('core', 120, 260), ('offset', 240, 330)) SELECT name, count(*) AS n, round(avg(v), 9) AS mean, round(24 * avg(daily.n), 9) AS per_day FROM w JOIN daily ON dopy BETWEEN a AND b GROUP BY 1""", "daily")
def window_stats(spark, d):
    """Rows to overlapping day windows by a broadcast range join."""
    w = spark.createDataFrame([("onset", 90, 150), ("core", 120, 260), ("offset", 240, 330)], "name string, a int, b int")
    x = s.daily(spark, d)
    return x.join(F.broadcast(w), F.col("dopy").between(F.col("a"), F.col("b"))).groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(24 * F.avg("n"), 9).alias("per_day"))


@query("enso_iod_context", f"""WITH y AS (SELECT year(date) AS year, (avg(v) FILTER (month(date) BETWEEN 8 AND 10) - 140) / 8 AS aso, (avg(n) FILTER (month(date) BETWEEN 9 AND 11) - 6) / 1 AS son FROM daily GROUP BY 1),
k AS (SELECT *, CASE WHEN aso >= 0.5 THEN 'ELNINO' WHEN aso <= -0.5 THEN 'LANINA' ELSE 'NETRAL' END AS enso, CASE WHEN son >= 0.4 THEN 'pIOD' WHEN son <= -0.4 THEN 'nIOD' ELSE 'NETRAL' END AS iod FROM y)
SELECT year, {r9('aso')} AS aso, {r9('son')} AS son, enso, iod, CASE WHEN (enso = 'ELNINO' AND iod = 'pIOD') OR (enso = 'LANINA' AND iod = 'nIOD') THEN 'SINERGI' WHEN (enso = 'ELNINO' AND iod = 'nIOD') OR (enso = 'LANINA' AND iod = 'pIOD') THEN 'COUNTER' ELSE 'NETRAL' END AS interaction FROM k""", "daily")
def enso_iod_context(spark, d):
    m = F.month("date")
    y = s.daily(spark, d).groupBy(F.year("date").cast("long").alias("year")).agg(((F.avg(F.when(m.between(8, 10), F.col("v"))) - 140) / 8).alias("aso"), (F.avg(F.when(m.between(9, 11), F.col("n"))) - 6).alias("son"))
    k = y.withColumns({"enso": c.enso_class("aso"), "iod": c.iod_class("son")})
    return k.select("year", r9c("aso").alias("aso"), r9c("son").alias("son"), "enso", "iod", c.interaction("enso", "iod").alias("interaction"))


@query("anomaly_flags", f"""WITH y AS (SELECT py, avg(v) AS a, max(dopy) - min(dopy) AS d FROM daily GROUP BY 1), z AS (SELECT *, abs(a - median(a) OVER ()) > 1.5 * stddev_samp(a) OVER () AS fa, abs(d - median(d) OVER ()) > 1.5 * stddev_samp(d) OVER () AS fd FROM y)
SELECT py, concat_ws(' ', CASE WHEN fa THEN 'level' END, CASE WHEN fd THEN 'duration' END) AS flags FROM z""", "daily")
def anomaly_flags(spark, d):
    w = Window.partitionBy(F.lit(1))
    y = s.daily(spark, d).groupBy("py").agg(F.avg("v").alias("a"), (F.max("dopy") - F.min("dopy")).alias("d"))
    off = lambda x: F.abs(F.col(x) - F.percentile(x, 0.5).over(w)) > 1.5 * F.stddev_samp(x).over(w)
    return y.withColumns({"fa": off("a"), "fd": off("d")}).select("py", F.concat_ws(" ", F.when(F.col("fa"), "level"), F.when(F.col("fd"), "duration")).alias("flags"))


@query("union_keep_first", "WITH u AS (SELECT date, v, 0 AS src FROM daily UNION ALL SELECT date, w, 1 FROM daily2) SELECT date, round(v, 8) AS v, CAST(src AS BIGINT) AS src FROM u QUALIFY row_number() OVER (PARTITION BY date ORDER BY src) = 1", "daily", "daily2")
def union_keep_first(spark, d):
    """Append sources and keep the first of each date: one aggregate, no sort."""
    a = s.daily(spark, d).select("date", "v", F.lit(0).alias("src"))
    b = s.daily2(spark, d).select("date", F.col("w").alias("v"), F.lit(1).alias("src"))
    first = a.unionByName(b).groupBy("date").agg(F.min(F.struct("src", "v")).alias("x"))
    return first.select("date", F.round("x.v", 8).alias("v"), F.col("x.src").cast("long").alias("src"))


@query("key_sets", "SELECT (SELECT count(*) FROM (SELECT date FROM daily UNION SELECT date FROM daily2)) AS n_union, (SELECT count(*) FROM (SELECT date FROM daily INTERSECT SELECT date FROM daily2)) AS n_both, (SELECT count(*) FROM (SELECT date FROM daily2 EXCEPT SELECT date FROM daily)) AS n_only2", "daily", "daily2")
def key_sets(spark, d):
    a = s.daily(spark, d).select("date", F.lit(1).alias("a"))
    b = s.daily2(spark, d).select("date", F.lit(1).alias("b"))
    return a.join(b, "date", "full").agg(F.count("*").alias("n_union"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("a").isNull()).alias("n_only2"))


@query("left_default_join", "SELECT daily.date, coalesce(w > 38, false) AS active FROM daily LEFT JOIN daily2 USING (date)", "daily", "daily2")
def left_default_join(spark, d):
    return s.daily(spark, d).join(s.daily2(spark, d), "date", "left").select("date", F.coalesce(F.col("w") > 38, F.lit(False)).alias("active"))


@query("anti_join", "SELECT date, round(w, 8) AS w FROM daily2 WHERE date NOT IN (SELECT date FROM daily)", "daily", "daily2")
def anti_join(spark, d):
    return s.daily2(spark, d).join(s.daily(spark, d).select("date"), "date", "left_anti").select("date", F.round("w", 8).alias("w"))


@query("tail_n", "SELECT date, round(v, 8) AS v FROM daily ORDER BY date DESC LIMIT 400", "daily")
def tail_n(spark, d):
    return s.daily(spark, d).orderBy(F.desc("date")).limit(400).select("date", F.round("v", 8).alias("v"))


@query("event_runs", "WITH x AS (SELECT date, v > 145 AS hot, row_number() OVER (ORDER BY date) AS rn FROM daily), y AS (SELECT *, rn - row_number() OVER (PARTITION BY hot ORDER BY date) AS g FROM x), r AS (SELECT g, count(*) AS len FROM y WHERE hot GROUP BY 1) SELECT count(*) FILTER (len >= 3) AS events, max(len) AS longest FROM r", "daily")
def event_runs(spark, d):
    """Runs of at least three days that meet a condition."""
    from skyloom.operators import extremes

    x = s.daily(spark, d).withColumns({"hot": F.col("v") > 145, "k": F.lit(1)})
    return extremes.run_lengths(x, "hot", "date", ["k"]).where("hot").agg(F.count_if(F.col("len") >= 3).alias("events"), F.max("len").alias("longest"))


@query("lead_probability", """WITH y AS (SELECT py, count(*) FILTER (v > 150 AND dopy BETWEEN 80 AND 95) AS lead, count(*) FILTER (v > 150 AND dopy BETWEEN 96 AND 180) AS events FROM daily GROUP BY 1)
SELECT py, lead, events, round(least(0.5 + CASE WHEN lead > 0 THEN 0.15 ELSE 0 END + CASE WHEN events >= 2 THEN 0.10 WHEN events = 1 THEN 0.05 ELSE 0 END, 0.95), 6) AS p FROM y""", "daily")
def lead_probability(spark, d):
    """Rule-based probability from events in the lead window and in the season, capped."""
    high = F.col("v") > 150
    y = s.daily(spark, d).groupBy("py").agg(F.count_if(high & F.col("dopy").between(80, 95)).alias("lead"), F.count_if(high & F.col("dopy").between(96, 180)).alias("events"))
    p = 0.5 + F.when(F.col("lead") > 0, 0.15).otherwise(0.0) + F.when(F.col("events") >= 2, 0.10).when(F.col("events") == 1, 0.05).otherwise(0.0)
    return y.select("py", "lead", "events", F.round(F.least(p, F.lit(0.95)), 6).alias("p"))
