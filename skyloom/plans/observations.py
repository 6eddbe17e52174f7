"""Queries over raw and hourly observations: roses, matrices, profiles, runs, extremes and station blends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators import blending, extremes, quantiles, wind
from skyloom.plans.registry import query
from skyloom.sources import surrogate as s

MEAN_DIR = "(degrees(atan2(avg(sin(radians({0}))), avg(cos(radians({0}))))) + 360) % 360"
R = "sqrt(pow(avg(sin(radians({0}))), 2) + pow(avg(cos(radians({0}))), 2))"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def dirs(x: str = "wd") -> str:
    r = f"least({R.format(x)}, 1.0)"
    return f"count({x}) AS n, {r6(MEAN_DIR.format(x))} AS mean_dir, {r6(R.format(x))} AS r, CASE WHEN {r} > 0 THEN {r6(f'degrees(sqrt(-2 * ln({r})))')} END AS sd_dir"


def sector_sql(n: int, x: str = "wd") -> str:
    return f"CAST(floor((({x} + {180.0 / n}) % 360) / {360.0 / n}) AS BIGINT) % {n}"


BIN = "CASE WHEN ws < 0 THEN 0 WHEN ws < 20 THEN 1 WHEN ws < 40 THEN 2 WHEN ws < 60 THEN 3 WHEN ws < 80 THEN 4 WHEN ws < 120 THEN 5 WHEN ws < 200 THEN 6 ELSE 7 END"
DAY = "(CAST(CAST(time AS DATE) - make_date(CAST(year(time) - CASE WHEN CAST(time AS DATE) < make_date(year(time), 6, 22) THEN 1 ELSE 0 END AS INT), 6, 22) AS DOUBLE) + hour(time) / 24.0) % 365"
MANGSA = "CASE " + " ".join(f"WHEN dopy >= {a} AND dopy < {b} THEN {n}" for n, a, b in wind.MANGSA_RANGES[:-1]) + " ELSE 12 END"
MUSIM = "CASE " + " ".join(f"WHEN mangsa BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in wind.MUSIM) + " END"


@query("wind_rose_16", f"SELECT {sector_sql(16)} AS sector, CAST({BIN} AS BIGINT) AS bin, count(*) AS n, {r6('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct, {r6('avg(ws)')} AS mean_ws FROM obs GROUP BY 1, 2", "obs")
def wind_rose_16(spark, d):
    rose = wind.wind_rose(s.obs(spark, d))
    return rose.select("sector", "bin", "n", c.rounded("pct").alias("pct"), c.rounded("mean_ws").alias("mean_ws"))


SEASON = "CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) IN (3, 4, 5) THEN 'MAM' WHEN month(time) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


@query("wind_rose_season", f"SELECT {SEASON} AS season, {sector_sql(8)} AS sector, CAST({BIN} AS BIGINT) AS bin, count(*) AS n, {r6(f'100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {SEASON})')} AS pct FROM obs GROUP BY 1, 2, 3", "obs")
def wind_rose_season(spark, d):
    m = F.month("time")
    season = F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")
    rose = wind.wind_rose(s.obs(spark, d).withColumn("season", season), 8, by=("season",))
    return rose.select("season", "sector", "bin", "n", c.rounded("pct").alias("pct"))


@query("wind_rose_all_rows", f"""SELECT {sector_sql(8)} AS sector, count(*) AS n, {r6("100.0 * count(*) / max(t.total)")} AS pct_all, {r6("avg(ws)")} AS mean_ws,
  {r6("sqrt(pow(avg(-ws * sin(radians(wd))), 2) + pow(avg(-ws * cos(radians(wd))), 2)) / avg(ws)")} AS constancy, {r6("100.0 * max(t.calm) / max(t.total)")} AS calm_pct
  FROM obs, (SELECT count(*) AS total, count(*) FILTER (ws < 2) AS calm FROM obs) t WHERE ws >= 2 GROUP BY 1""", "obs")
def wind_rose_all_rows(spark, d):
    """The variant whose shares are of all rows, calm ones included, with the constancy of each sector."""
    o = s.obs(spark, d)
    total = o.agg(F.count("*").alias("total"), F.count_if(F.col("ws") < 2).alias("calm"))
    uv = o.where("ws >= 2").withColumns({"u": c.wind_u("wd", "ws"), "v": c.wind_v("wd", "ws")})
    per = uv.groupBy(c.sector("wd", 8).alias("sector")).agg(F.count("*").alias("n"), c.rounded(F.avg("ws")).alias("mean_ws"), c.rounded(c.constancy("u", "v")).alias("constancy"))
    return per.crossJoin(F.broadcast(total)).select("sector", "n", c.rounded(100.0 * F.col("n") / F.col("total")).alias("pct_all"), "mean_ws", "constancy", c.rounded(100.0 * F.col("calm") / F.col("total")).alias("calm_pct"))


@query("monthly_circular_stats", f"SELECT month(time) AS month, {dirs()}, {r6('avg(ws)')} AS mean, {r6('quantile_cont(ws, 0.1)')} AS p10, {r6('quantile_cont(ws, 0.5)')} AS p50, {r6('quantile_cont(ws, 0.9)')} AS p90, {r6('max(ws)')} AS max, {r6('max(gust)')} AS max_gust FROM obs GROUP BY 1", "obs")
def monthly_circular_stats(spark, d):
    return wind.monthly_stats(s.obs(spark, d))


@query("diurnal_matrix", f"SELECT hour(time) AS hour, month(time) AS month, {r6('avg(ws)')} AS mean, count(ws) AS n FROM obs GROUP BY 1, 2", "obs")
def diurnal_matrix(spark, d):
    return s.obs(spark, d).groupBy(F.hour("time").cast("long").alias("hour"), F.month("time").cast("long").alias("month")).agg(c.rounded(F.avg("ws")).alias("mean"), F.count("ws").alias("n"))


@query("diurnal_matrix_wide", "SELECT hour(time) AS hour, " + ", ".join(f"{r6(f'avg(ws) FILTER (month(time) = {m})')} AS m{m}" for m in range(1, 13)) + " FROM obs GROUP BY 1", "obs")
def diurnal_matrix_wide(spark, d):
    """The same matrix as 24 rows of 12 months: one conditional aggregate instead of a pivot's extra pass."""
    m = F.month("time")
    return s.obs(spark, d).groupBy(F.hour("time").cast("long").alias("hour")).agg(*[c.rounded(F.avg(F.when(m == k, F.col("ws")))).alias(f"m{k}") for k in range(1, 13)])


@query("diurnal_direction", f"SELECT hour(time) AS hour, {dirs()} FROM obs GROUP BY 1", "obs")
def diurnal_direction(spark, d):
    return s.obs(spark, d).groupBy(F.hour("time").cast("long").alias("hour")).agg(*wind.direction_summary())


U, V = "(-ws * sin(radians(wd)))", "(-ws * cos(radians(wd)))"


@query("diurnal_cycle", f"""SELECT hour(time) AS hour, count(*) AS n, {r6('avg(ws)')} AS mean, {r6('stddev_samp(ws)')} AS sd, {r6('median(ws)')} AS median, {r6('quantile_cont(ws, 0.25)')} AS p25, {r6('quantile_cont(ws, 0.75)')} AS p75,
  {r6('max(ws)')} AS max, {r6('avg(gust)')} AS mean_gust, {r6(f'avg({U})')} AS u, {r6(f'avg({V})')} AS v, {r6(f'(degrees(atan2(-avg({U}), -avg({V}))) + 360) % 360')} AS vector_dir,
  {r6(f'sqrt(pow(avg({U}), 2) + pow(avg({V}), 2)) / avg(ws)')} AS constancy FROM obs GROUP BY 1""", "obs")
def diurnal_cycle(spark, d):
    uv = s.obs(spark, d).withColumns({"u": c.wind_u("wd", "ws"), "v": c.wind_v("wd", "ws"), "hour": F.hour("time").cast("long")})
    stats = uv.groupBy("hour").agg(
        F.count("*").alias("n"), c.rounded(F.avg("ws")).alias("mean"), c.rounded(F.stddev_samp("ws")).alias("sd"),
        c.rounded(F.max("ws")).alias("max"), c.rounded(F.avg("gust")).alias("mean_gust"), c.rounded(F.avg("u")).alias("u"), c.rounded(F.avg("v")).alias("v"),
        c.rounded(c.direction_of(F.avg("u"), F.avg("v"))).alias("vector_dir"), c.rounded(c.constancy("u", "v")).alias("constancy"),
    )
    return wind.with_speed_percentiles(uv, stats, ["hour"], {"median": ("ws", 0.5), "p25": ("ws", 0.25), "p75": ("ws", 0.75)}, 25)


@query("harmonic_amplitude", f"""WITH h AS (SELECT hour(time) AS h, avg(ws) AS v FROM obs GROUP BY 1), x AS (SELECT 2 * avg(v * cos(2 * pi() * h / 12)) AS a, 2 * avg(v * sin(2 * pi() * h / 12)) AS b FROM h)
SELECT {r6('sqrt(a * a + b * b)')} AS amplitude, {r6('((degrees(atan2(b, a)) + 360) % 360) / 30')} AS phase_hours FROM x""", "obs")
def harmonic_amplitude(spark, d):
    """Semidiurnal harmonic of the mean day."""
    h = s.obs(spark, d).groupBy(F.hour("time").alias("h")).agg(F.avg("ws").alias("v"))
    turn = 2 * F.pi() * F.col("h") / 12
    x = h.agg((2 * F.avg(F.col("v") * F.cos(turn))).alias("a"), (2 * F.avg(F.col("v") * F.sin(turn))).alias("b"))
    return x.select(c.rounded(F.hypot("a", "b")).alias("amplitude"), c.rounded(F.pmod(F.degrees(F.atan2("b", "a")), F.lit(360.0)) / 30).alias("phase_hours"))


@query("gust_stats", f"WITH g AS (SELECT gust / ws AS gf FROM obs WHERE ws >= 1) SELECT count(*) AS n, {r6('avg(gf)')} AS mean, {r6('quantile_cont(gf, 0.5)')} AS p50, {r6('quantile_cont(gf, 0.9)')} AS p90, {r6('quantile_cont(gf, 0.99)')} AS p99 FROM g", "obs")
def gust_stats(spark, d):
    return wind.gust_stats(s.obs(spark, d))


LEVELS = (20.0, 40.0, 60.0, 80.0, 100.0, 150.0, 200.0, 300.0)


@query("exceedance_table", "WITH l AS (UNPIVOT (SELECT ws, gust, cloud FROM obs) ON ws, gust, cloud INTO NAME field VALUE x), t AS (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in LEVELS) + f"]) AS threshold) SELECT field, threshold, count(*) FILTER (x >= threshold) AS hits, {r6('100.0 * count(*) FILTER (x >= threshold) / count(*)')} AS pct FROM l, t GROUP BY 1, 2", "obs")
def exceedance_table(spark, d):
    return wind.exceedance(s.obs(spark, d), ("ws", "gust", "cloud"), LEVELS)


@query("gust_exceedance", "WITH t AS (SELECT unnest([50.0::DOUBLE, 75, 100, 150, 200]) AS threshold) SELECT 'gust' AS field, threshold, count(*) FILTER (gust >= threshold) AS hits, " + r6("100.0 * count(*) FILTER (gust >= threshold) / count(*)") + " AS pct FROM obs, t GROUP BY 2", "obs")
def gust_exceedance(spark, d):
    return wind.exceedance(s.obs(spark, d), ("gust",), (50.0, 75.0, 100.0, 150.0, 200.0))


@query("gust_histogram", "SELECT CAST(least(floor((gust / ws - 0.5) / 0.5), 13) AS BIGINT) AS bin, count(*) AS n FROM obs WHERE ws > 0 AND gust / ws BETWEEN 0.5 AND 7.5 GROUP BY 1", "obs")
def gust_histogram(spark, d):
    return wind.histogram(s.obs(spark, d).where("ws > 0").withColumn("gf", F.col("gust") / F.col("ws")), "gf", 0.5, 0.5, 14)


@query("beaufort_classes", "SELECT CAST(CASE " + " ".join(f"WHEN ws < {x} THEN {i}" for i, x in enumerate(c.BEAUFORT)) + " ELSE 12 END AS BIGINT) AS beaufort, count(*) AS n FROM obs GROUP BY 1", "obs")
def beaufort_classes(spark, d):
    return s.obs(spark, d).groupBy(c.beaufort("ws").alias("beaufort")).agg(F.count("*").alias("n"))


@query("mangsa_profile", f"""WITH f AS (SELECT *, {DAY} AS dopy FROM obs), m AS (SELECT *, {MANGSA} AS mangsa FROM f)
SELECT k.mangsa, coalesce(x.n, 0) AS n, mean_dir, r, sd_dir, mean, p50, p90 FROM (SELECT unnest(generate_series(1, 12)) AS mangsa) k LEFT JOIN
  (SELECT mangsa, {dirs()}, {r6('avg(ws)')} AS mean, {r6('quantile_cont(ws, 0.5)')} AS p50, {r6('quantile_cont(ws, 0.9)')} AS p90 FROM m GROUP BY 1) x ON k.mangsa = x.mangsa""", "obs")
def mangsa_profile(spark, d):
    return wind.mangsa_profile(s.obs(spark, d))


@query("musim_quadrants", f"""WITH f AS (SELECT *, {DAY} AS dopy FROM obs), m AS (SELECT *, {MANGSA} AS mangsa FROM f)
SELECT {MUSIM} AS musim, count(*) AS n, {r6("100 * avg(CASE WHEN wd >= 202 AND wd < 292 THEN 1.0 ELSE 0 END)")} AS west_pct, {r6("100 * avg(CASE WHEN wd >= 90 AND wd < 180 THEN 1.0 ELSE 0 END)")} AS southeast_pct FROM m GROUP BY 1""", "obs")
def musim_quadrants(spark, d):
    share = lambda a, b: c.rounded(100 * F.avg(F.when((F.col("wd") >= a) & (F.col("wd") < b), 1.0).otherwise(0.0)))
    return wind.time_features(s.obs(spark, d)).groupBy(wind.musim_of("mangsa").alias("musim")).agg(F.count("*").alias("n"), share(202, 292).alias("west_pct"), share(90, 180).alias("southeast_pct"))


#: Months of the four wind regimes: fixed values.
REGIMES = {"MB": (1, 2, 3), "PML1": (4, 5), "MT": (6, 7, 8, 9), "PML2": (10, 11, 12)}
REGIME = "CASE " + " ".join(f"WHEN month(time) IN {m} THEN '{k}'" for k, m in REGIMES.items()) + " END"


def regime_of(month):
    out = F.lit(None).cast("string")
    for k, m in REGIMES.items():
        out = F.when(month.isin(*m), k).otherwise(out)
    return out


VECTOR = f"{r6('avg(-ws * sin(radians(wd)))')} AS u, {r6('avg(-ws * cos(radians(wd)))')} AS v, {r6('sqrt(pow(avg(-ws * sin(radians(wd))), 2) + pow(avg(-ws * cos(radians(wd))), 2)) / nullif(avg(ws), 0)')} AS constancy"


def vector_summary():
    u, v = F.avg(c.wind_u("wd", "ws")), F.avg(c.wind_v("wd", "ws"))
    return [c.rounded(u).alias("u"), c.rounded(v).alias("v"), c.rounded(F.sqrt(u * u + v * v) / F.nullif(F.avg("ws"), F.lit(0.0))).alias("constancy")]


@query("regime_stats", f"""WITH x AS (SELECT *, {REGIME} AS regime, {sector_sql(8)} AS sector FROM years), h AS (SELECT regime, max(m) - min(m) AS swing FROM (SELECT regime, hour(time) AS hour, avg(ws) AS m FROM x GROUP BY ALL) GROUP BY 1),
n AS (SELECT regime, sector, count(*) AS n FROM x WHERE ws >= 2 GROUP BY ALL), d AS (SELECT regime, arg_min(sector, (-n, sector)) AS dominant FROM n GROUP BY 1)
SELECT regime, count(*) AS n, {r6('avg(ws)')} AS speed, {VECTOR}, {r6('100 * avg(CASE WHEN ws < 2 THEN 1.0 ELSE 0 END)')} AS calm_pct, any_value(dominant) AS dominant, {r6('any_value(swing)')} AS diurnal_swing FROM x JOIN h USING (regime) LEFT JOIN d USING (regime) GROUP BY 1""", "years")
def regime_stats(spark, d):
    """Four month regimes: vector mean, constancy, calms, dominant sector of the rose and the swing of the hourly means, from one pre-aggregate."""
    x = s.years(spark, d).withColumns({"regime": regime_of(F.month("time")), "sector": c.sector("wd", 8)})
    every = x.groupBy("regime").agg(F.count("*").alias("n"), c.rounded(F.avg("ws")).alias("speed"), *vector_summary(), c.rounded(100 * F.avg(F.when(F.col("ws") < 2, 1.0).otherwise(0.0))).alias("calm_pct"))
    swing = x.groupBy("regime", F.hour("time")).agg(F.avg("ws").alias("m")).groupBy("regime").agg(c.rounded(F.max("m") - F.min("m")).alias("diurnal_swing"))
    rose = x.where("ws >= 2").groupBy("regime", "sector").count().groupBy("regime").agg(F.min(F.struct((-F.col("count")).alias("k"), "sector"))["sector"].alias("dominant"))
    return every.join(F.broadcast(swing), "regime").join(F.broadcast(rose), "regime", "left")


@query("regime_rose", f"WITH x AS (SELECT {REGIME} AS regime, {sector_sql(8)} AS sector, CAST({BIN} AS BIGINT) AS bin FROM years) SELECT regime, sector, bin, count(*) AS n, {r6('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY regime)')} AS pct FROM x GROUP BY regime, sector, bin", "years")
def regime_rose(spark, d):
    rose = wind.wind_rose(s.years(spark, d).withColumn("regime", regime_of(F.month("time"))), 8, by=("regime",))
    return rose.select("regime", "sector", "bin", "n", c.rounded("pct").alias("pct"))


MONTHLY = f"""m AS (SELECT month(time) AS month, count(*) AS n, avg(ws) AS speed, {VECTOR} FROM years GROUP BY 1)"""


@query("annual_cycle", f"""WITH {MONTHLY},
h AS (SELECT count(*) AS k, sum(speed * cos(2 * pi() * month / 12)) AS sc, sum(speed * sin(2 * pi() * month / 12)) AS ss, avg(speed) AS mean FROM m),
o AS (SELECT arg_min(month, month % 12) FILTER (month IN (12, 1, 2, 3) AND constancy > 0.5) AS wet_onset, min(month) FILTER (month IN (6, 7, 8, 9) AND constancy > 0.5) AS dry_onset, coalesce(string_agg(month::VARCHAR, ',' ORDER BY month) FILTER (constancy < 0.3), '') AS turning FROM m)
SELECT CAST(h.k AS BIGINT) AS months, CASE WHEN h.k = 12 THEN {r6('2 * sqrt(sc * sc + ss * ss) / 12')} END AS amplitude, CASE WHEN h.k = 12 THEN {r6('((degrees(atan2(ss, sc)) + 360) % 360) / 30')} END AS phase_month, {r6('mean')} AS mean_speed, wet_onset, dry_onset, turning FROM h, o""", "years")
def annual_cycle(spark, d):
    """Twelve-month harmonic of the monthly speed, first months of constant wind in either season, and the months without.

    Twelve equally spaced months make the least-squares harmonic a pair of sums.
    """
    m = s.years(spark, d).groupBy(F.month("time").cast("long").alias("month")).agg(F.avg("ws").alias("speed"), *vector_summary())
    angle, steady = 2 * F.pi() * F.col("month") / 12, F.col("constancy") > 0.5
    first = lambda months: F.min(F.when(F.col("month").isin(*months) & steady, F.struct((F.col("month") % 12).alias("k"), "month")))["month"]
    h = m.agg(
        F.count("*").alias("months"), F.sum(F.col("speed") * F.cos(angle)).alias("sc"), F.sum(F.col("speed") * F.sin(angle)).alias("ss"), F.avg("speed").alias("mean"),
        first((12, 1, 2, 3)).alias("wet_onset"), first((6, 7, 8, 9)).alias("dry_onset"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("constancy") < 0.3, F.col("month")))), ",").alias("turning"),
    )
    full = F.col("months") == 12
    return h.select(
        "months", F.when(full, c.rounded(2 * F.sqrt(F.col("sc") * F.col("sc") + F.col("ss") * F.col("ss")) / 12)).alias("amplitude"),
        F.when(full, c.rounded(F.pmod(F.degrees(F.atan2("ss", "sc")), F.lit(360.0)) / 30)).alias("phase_month"), c.rounded("mean").alias("mean_speed"), "wet_onset", "dry_onset", "turning",
    )


@query("sector_cloud", f"SELECT {sector_sql(8)} AS sector, count(*) AS n, {r6('avg(cloud)')} AS cloud, {r6('avg(precip)')} AS precip, {r6('100.0 * avg(CASE WHEN precip > 0.5 THEN 1.0 ELSE 0 END)')} AS wet_pct FROM obs GROUP BY 1", "obs")
def sector_cloud(spark, d):
    return s.obs(spark, d).groupBy(c.sector("wd", 8).alias("sector")).agg(F.count("*").alias("n"), c.rounded(F.avg("cloud")).alias("cloud"), c.rounded(F.avg("precip")).alias("precip"), c.rounded(100.0 * F.avg(F.when(F.col("precip") > 0.5, 1.0).otherwise(0.0))).alias("wet_pct"))


@query("intensity_composite", f"""SELECT CASE WHEN precip < 0.05 THEN 'dry' WHEN precip < 1 THEN 'light' WHEN precip < 5 THEN 'moderate' ELSE 'heavy' END AS intensity, count(*) AS n, {r6('avg(ws)')} AS ws, {r6('avg(cloud)')} AS cloud,
  {r6(MEAN_DIR.format('wd'))} AS mean_dir FROM obs GROUP BY 1""", "obs")
def intensity_composite(spark, d):
    p = F.col("precip")
    level = F.when(p < 0.05, "dry").when(p < 1, "light").when(p < 5, "moderate").otherwise("heavy")
    return s.obs(spark, d).groupBy(level.alias("intensity")).agg(F.count("*").alias("n"), c.rounded(F.avg("ws")).alias("ws"), c.rounded(F.avg("cloud")).alias("cloud"), c.rounded(c.circular_mean("wd")).alias("mean_dir"))


@query("speed_components", f"SELECT event_id, {r6('-ws * sin(radians(wd))')} AS u, {r6('-ws * cos(radians(wd))')} AS v, {r6('round(((degrees(atan2(ws * sin(radians(wd)), ws * cos(radians(wd)))) + 360) % 360), 6) % 360')} AS back, {sector_sql(8)} AS sector FROM obs WHERE ws > 0", "obs")
def speed_components(spark, d):
    o = s.obs(spark, d).where("ws > 0").withColumns({"u": c.wind_u("wd", "ws"), "v": c.wind_v("wd", "ws")})
    return o.select("event_id", c.rounded("u").alias("u"), c.rounded("v").alias("v"), c.rounded(F.round(c.direction_of("u", "v"), 6) % 360).alias("back"), c.sector("wd", 8).alias("sector"))


#: Upper limits of the exponent in the stability classes: fixed values.
STABILITY = (("very_unstable", 0.05), ("unstable", 0.12), ("neutral", 0.20), ("stable", 0.35), ("very_stable", None))
_LOW = [None, *[x for _, x in STABILITY[:-1]]]
_SHARES = ", ".join(r6("100 * avg(CASE WHEN " + " AND ".join(filter(None, [f"alpha >= {lo}" if lo else "", f"alpha < {hi}" if hi else ""])) + " THEN 1.0 ELSE 0 END)") + f" AS {n}" for (n, hi), lo in zip(STABILITY, _LOW, strict=True))
ALPHA = "x AS (SELECT hour(time) AS hour, month(time) AS month, ln(greatest(gust / ws, 1e-6)) / ln(10) AS alpha FROM obs WHERE ws > 0.5 AND gust > 0.5)"
PART = "CASE WHEN hour BETWEEN 9 AND 17 THEN 'day' WHEN hour >= 21 OR hour <= 6 THEN 'night' ELSE 'between' END"


def exponents(spark, d):
    """Hellmann exponent of two levels ten times apart."""
    return s.obs(spark, d).where("ws > 0.5 and gust > 0.5").select(F.hour("time").cast("long").alias("hour"), F.month("time").cast("long").alias("month"), (F.log(F.greatest(F.col("gust") / F.col("ws"), F.lit(1e-6))) / F.log(F.lit(10.0))).alias("alpha"))


def stability():
    a, out = F.col("alpha"), []
    for (name, high), low in zip(STABILITY, _LOW, strict=True):
        inside = F.lit(True) if low is None else a >= low
        out.append(c.rounded(100 * F.avg(F.when(inside & (a < high if high else F.lit(True)), 1.0).otherwise(0.0))).alias(name))
    return out


def _shear(name: str, key: str, sql: str, column):
    @query(name, f"WITH {ALPHA} SELECT {sql} AS {key}, count(*) AS n, {r6('avg(alpha)')} AS mean, {r6('median(alpha)')} AS median, {_SHARES} FROM x GROUP BY 1", "obs")
    def q(spark, d):
        rows = exponents(spark, d).withColumn(key, column())
        stats = rows.groupBy(key).agg(F.count("*").alias("n"), c.rounded(F.avg("alpha")).alias("mean"), *stability())
        return wind.with_speed_percentiles(rows, stats, [key], {"median": ("alpha", 0.5)}, 32)


_shear("shear_profile", "hour", "hour", lambda: F.col("hour"))
_shear("shear_by_month", "month", "month", lambda: F.col("month"))
_shear("shear_day_night", "part", PART, lambda: F.when(F.col("hour").between(9, 17), "day").when((F.col("hour") >= 21) | (F.col("hour") <= 6), "night").otherwise("between"))


@query("transition_analysis", f"""WITH x AS (SELECT station, hour(hour) AS hour, (wd - lag(wd) OVER (PARTITION BY station ORDER BY hour) + 540) % 360 - 180 AS turn FROM hourly)
SELECT station, hour, count(turn) AS n, {r6('avg(abs(turn))')} AS mean_turn, {r6('avg(CASE WHEN turn > 45 THEN 1.0 ELSE 0 END)')} AS veer, {r6('avg(CASE WHEN turn < -45 THEN 1.0 ELSE 0 END)')} AS back, {r6('avg(CASE WHEN abs(turn) > 90 THEN 1.0 ELSE 0 END)')} AS rapid FROM x WHERE turn IS NOT NULL GROUP BY 1, 2""", "hourly")
def transition_analysis(spark, d):
    """Turns of the hourly direction of every station; the windows run over hours, not over raw rows."""
    x = s.hourly(spark, d).withColumn("turn", c.circular_difference("wd", F.lag("wd").over(Window.partitionBy("station").orderBy("hour")))).where("turn is not null")
    share = lambda k: c.rounded(F.avg(F.when(k, 1.0).otherwise(0.0)))
    t = F.col("turn")
    return x.groupBy("station", F.hour("hour").cast("long").alias("hour")).agg(F.count("turn").alias("n"), c.rounded(F.avg(F.abs(t))).alias("mean_turn"), share(t > 45).alias("veer"), share(t < -45).alias("back"), share(F.abs(t) > 90).alias("rapid"))


@query("sector_run_lengths", f"""WITH x AS (SELECT station, hour, {sector_sql(8)} AS sector, row_number() OVER (PARTITION BY station ORDER BY hour) AS rn FROM hourly),
y AS (SELECT *, rn - row_number() OVER (PARTITION BY station, sector ORDER BY hour) AS island FROM x), z AS (SELECT station, sector, island, count(*) AS len FROM y GROUP BY ALL)
SELECT sector, count(*) AS runs, max(len) AS longest, {r6('avg(len)')} AS mean_len FROM z GROUP BY 1""", "hourly")
def sector_run_lengths(spark, d):
    return extremes.run_lengths(s.hourly(spark, d).withColumn("sector", c.sector("wd", 8)), "sector", "hour", ["station"]).groupBy("sector").agg(
        F.count("*").alias("runs"), F.max("len").alias("longest"), c.rounded(F.avg("len")).alias("mean_len")
    )


@query("sector_transitions", f"""WITH x AS (SELECT {sector_sql(8)} AS a, lead({sector_sql(8)}) OVER (PARTITION BY station ORDER BY hour) AS b FROM hourly), n AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY ALL)
SELECT k.a AS from_sector, j.b AS to_sector, coalesce(n, 0) AS n, {r6('coalesce(n / sum(n) OVER (PARTITION BY k.a), 0)')} AS p
FROM (SELECT unnest(generate_series(0, 7)) AS a) k CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS b) j LEFT JOIN n ON n.a = k.a AND n.b = j.b""", "hourly")
def sector_transitions(spark, d):
    return extremes.transitions(s.hourly(spark, d).withColumn("sector", c.sector("wd", 8)), "sector", "hour", ["station"], 8)


@query("top_n_extremes", f"SELECT event_id, {r6('gust')} AS gust, {r6('ws')} AS ws FROM obs ORDER BY obs.gust DESC, time, event_id LIMIT 30", "obs")
def top_n_extremes(spark, d):
    return s.obs(spark, d).orderBy(F.desc("gust"), "time", "event_id").limit(30).select("event_id", c.rounded("gust").alias("gust"), c.rounded("ws").alias("ws"))


@query("max_per_day", f"SELECT CAST(time AS DATE) AS date, arg_min(event_id, (-gust, time, event_id)) AS event_id, {r6('max(gust)')} AS gust FROM obs GROUP BY 1", "obs")
def max_per_day(spark, d):
    """First of the highest values of each day, as one minimum of (-value, time): no sort of the day's rows."""
    best = F.min(F.struct((-F.col("gust")).alias("g"), "time", "event_id")).alias("b")
    return s.obs(spark, d).groupBy(F.to_date("time").alias("date")).agg(best).select("date", "b.event_id", c.rounded(-F.col("b.g")).alias("gust"))


QS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999)


@query("percentile_table", "WITH l AS (UNPIVOT (SELECT ws, gust, cloud FROM obs) ON ws, gust, cloud INTO NAME field VALUE x), q AS (SELECT field, quantile_cont(x, [" + ", ".join(map(str, QS)) + "]) AS v FROM l GROUP BY 1) SELECT field, unnest([" + ", ".join(f"{q}::DOUBLE" for q in QS) + f"]) AS q, round(unnest(v), 6) + 0.0 AS x FROM q", "obs")
def percentile_table(spark, d):
    return extremes.percentile_table(s.obs(spark, d), ("ws", "gust", "cloud"), QS)


@query("extreme_clusters", f"""WITH t AS (SELECT quantile_cont(ws, 0.99) AS thr FROM series), x AS (SELECT hour, ws FROM series, t WHERE ws >= thr),
y AS (SELECT *, CASE WHEN date_diff('minute', lag(hour) OVER (ORDER BY hour), hour) <= 360 THEN 0 ELSE 1 END AS new FROM x), z AS (SELECT *, sum(new) OVER (ORDER BY hour) AS event FROM y)
SELECT min(hour) AS start, max(hour) AS stop, count(*) AS n, {r6('max(ws)')} AS peak, {r6('avg(ws)')} AS mean FROM z GROUP BY event""", "series")
def extreme_clusters(spark, d):
    return extremes.clusters(s.series(spark, d), "ws", "hour", 0.99, 6)


@query("rain_onset_candidates", f"""WITH x AS (SELECT hour, precip, max(precip) OVER w AS before, count(*) OVER w AS n FROM series WINDOW w AS (ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT hour, {r6('precip')} AS precip FROM x WHERE precip > 2 AND n = 3 AND before < 2""", "series")
def rain_onset_candidates(spark, d):
    return extremes.onset_candidates(s.series(spark, d), "precip", "hour", dry=3, wet=2.0, dry_below=2.0).select("hour", c.rounded("precip").alias("precip"))


@query("superposed_epoch", f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY hour) AS rn FROM series), x AS (SELECT *, max(precip) OVER w AS before, count(*) OVER w AS k FROM r WINDOW w AS (ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
e AS (SELECT rn FROM x WHERE precip > 2 AND k = 3 AND before < 2) SELECT r.rn - e.rn AS lag, count(*) AS n, {r6('avg(r.ws)')} AS ws, {r6('avg(r.cloud)')} AS cloud FROM e JOIN r ON r.rn BETWEEN e.rn - 12 AND e.rn + 12 GROUP BY 1""", "series")
def superposed_epoch(spark, d):
    x = s.series(spark, d)
    events = extremes.onset_candidates(x, "precip", "hour", dry=3, wet=2.0, dry_below=2.0)
    return extremes.superposed_epoch(x, events, "hour", ("ws", "cloud"), 12)


@query("station_merge_scalar", f"SELECT coalesce(a.hour, b.hour) AS hour, round(coalesce(0.4154 * a.ws + 0.5846 * b.ws, a.ws, b.ws), 9) AS ws, round(coalesce(0.4996 * a.cloud + 0.5004 * b.cloud, a.cloud, b.cloud), 9) AS cloud FROM (FROM hourly WHERE station = 0) a FULL JOIN (FROM hourly WHERE station = 1) b ON a.hour = b.hour", "hourly")
def station_merge_scalar(spark, d):
    return blending.merged(s.hourly(spark, d)).select("hour", F.round("ws", 9).alias("ws"), F.round("cloud", 9).alias("cloud"))


@query("station_merge_direction", f"""SELECT coalesce(a.hour, b.hour) AS hour, CASE WHEN a.wd IS NULL THEN {r6('b.wd')} WHEN b.wd IS NULL THEN {r6('a.wd')} ELSE
  {r6('(degrees(atan2(0.4154 * sin(radians(a.wd)) + 0.5846 * sin(radians(b.wd)), 0.4154 * cos(radians(a.wd)) + 0.5846 * cos(radians(b.wd)))) + 360) % 360')} END AS wd FROM (FROM hourly WHERE station = 0) a FULL JOIN (FROM hourly WHERE station = 1) b ON a.hour = b.hour""", "hourly")
def station_merge_direction(spark, d):
    return blending.merged(s.hourly(spark, d)).select("hour", c.rounded("wd").alias("wd"))


@query("station_inner_join", f"SELECT a.hour, {r6('a.ws - b.ws')} AS diff FROM hourly a JOIN hourly b ON a.hour = b.hour WHERE a.station = 0 AND b.station = 1", "hourly")
def station_inner_join(spark, d):
    a, b = blending.split(s.hourly(spark, d))
    return a.join(b, "hour").select("hour", c.rounded(F.col("ws_1") - F.col("ws_2")).alias("diff"))


@query("station_diagnostics", f"""WITH l AS (SELECT hour, station, unnest(['ws', 'gust', 'cloud', 'precip']) AS field, unnest([ws, gust, cloud, precip]) AS x FROM hourly),
p AS (SELECT a.field, a.x AS x, b.x AS y, a.x - b.x AS d FROM l a JOIN l b ON a.hour = b.hour AND a.field = b.field WHERE a.station = 0 AND b.station = 1)
SELECT field, count(*) AS n, {r6('avg(d)')} AS bias, {r6('stddev_samp(d)')} AS sd, {r6('sqrt(avg(d * d))')} AS rmsd, {r6('avg(abs(d))')} AS mae, {r6('corr(x, y)')} AS r FROM p GROUP BY 1""", "hourly")
def station_diagnostics(spark, d):
    return blending.diagnostics(s.hourly(spark, d), ["ws", "gust", "cloud", "precip"])


@query("mode_map_join", f"WITH m AS (SELECT sector, {r6('avg(ws)')} AS sector_mean FROM (SELECT {sector_sql(8)} AS sector, ws FROM obs) GROUP BY 1) SELECT event_id, sector_mean FROM obs JOIN m ON m.sector = {sector_sql(8)}", "obs")
def mode_map_join(spark, d):
    """Map join: each row looks its class's value up in a table of eight rows."""
    o = s.obs(spark, d).withColumn("sector", c.sector("wd", 8))
    means = o.groupBy("sector").agg(c.rounded(F.avg("ws")).alias("sector_mean"))
    return o.join(F.broadcast(means), "sector", "left").select("event_id", "sector_mean")


@query("cut_qcut_classes", f"""WITH q AS (SELECT quantile_cont(ws, 0.25) AS a, quantile_cont(ws, 0.5) AS b, quantile_cont(ws, 0.75) AS c FROM obs),
x AS (SELECT ws, CASE WHEN ws <= 0 THEN NULL WHEN ws <= 25 THEN '(0, 25]' WHEN ws <= 50 THEN '(25, 50]' WHEN ws <= 100 THEN '(50, 100]' ELSE '>100' END AS cut, CASE WHEN ws <= a THEN 1 WHEN ws <= b THEN 2 WHEN ws <= c THEN 3 ELSE 4 END AS quarter FROM obs, q)
SELECT cut, CAST(quarter AS BIGINT) AS quarter, count(*) AS n, {r6('avg(ws)')} AS mean FROM x GROUP BY 1, 2""", "obs")
def cut_qcut_classes(spark, d):
    """Right-closed classes, and classes by quantile edges (ties stay together, unlike ntile)."""
    o = s.obs(spark, d)
    edges = quantiles.percentiles(o, [], {f"q{i}": ("ws", q) for i, q in enumerate((0.25, 0.5, 0.75))}, 1)
    w = F.col("ws")
    cut = F.when(w <= 0, None).when(w <= 25, "(0, 25]").when(w <= 50, "(25, 50]").when(w <= 100, "(50, 100]").otherwise(">100")
    quarter = F.when(w <= F.col("q0"), 1).when(w <= F.col("q1"), 2).when(w <= F.col("q2"), 3).otherwise(4).cast("long")
    return o.crossJoin(F.broadcast(edges)).groupBy(cut.alias("cut"), quarter.alias("quarter")).agg(F.count("*").alias("n"), c.rounded(F.avg("ws")).alias("mean"))


BREEZE = """CAST(time AS DATE) AS date, avg(CASE WHEN hour(time) BETWEEN 10 AND 17 THEN ws END) AS day_speed, avg(CASE WHEN hour(time) >= 22 OR hour(time) <= 5 THEN ws END) AS night_speed, avg(CASE WHEN hour(time) BETWEEN 10 AND 17 THEN 10 * (100 - cloud) END) AS radiation"""


@query("sea_breeze_days", f"""WITH x AS (SELECT {MEAN_DIR.format('CASE WHEN hour(time) BETWEEN 10 AND 17 THEN wd END')} AS day_dir, {MEAN_DIR.format('CASE WHEN hour(time) >= 22 OR hour(time) <= 5 THEN wd END')} AS night_dir, {BREEZE} FROM obs GROUP BY date)
SELECT date, {r6('day_dir')} AS day_dir, {r6('night_dir')} AS night_dir, coalesce((day_dir >= 315 OR day_dir <= 90) AND night_dir >= 135 AND night_dir <= 270 AND coalesce(day_speed, 0) > coalesce(night_speed, 0) AND coalesce(radiation, 0) > 150, false) AS breeze FROM x""", "obs")
def sea_breeze_days(spark, d):
    """Days with wind from the sea by day, from the land by night, stronger by day and in the sun (here what clouds leave of 1000)."""
    h = F.hour("time")
    day, night = h.between(10, 17), (h >= 22) | (h <= 5)
    x = s.obs(spark, d).withColumns({"_day": F.when(day, F.col("wd")), "_night": F.when(night, F.col("wd"))})
    y = x.groupBy(F.to_date("time").alias("date")).agg(
        c.circular_mean("_day").alias("day_dir"), c.circular_mean("_night").alias("night_dir"), F.coalesce(F.avg(F.when(day, F.col("ws"))), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.when(night, F.col("ws"))), F.lit(0.0)).alias("b"),
        F.coalesce(F.avg(F.when(day, 10 * (100 - F.col("cloud")))), F.lit(0.0)).alias("sun"),
    )
    breeze = ((F.col("day_dir") >= 315) | (F.col("day_dir") <= 90)) & F.col("night_dir").between(135, 270) & (F.col("a") > F.col("b")) & (F.col("sun") > 150)
    return y.select("date", c.rounded("day_dir").alias("day_dir"), c.rounded("night_dir").alias("night_dir"), F.coalesce(breeze, F.lit(False)).alias("breeze"))


@query("hourly_grid", f"""WITH r AS (SELECT min(hour) AS a, max(hour) AS b FROM series), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM r) SELECT g.hour, {r6('ws')} AS ws, ws IS NULL AS gap FROM g LEFT JOIN series USING (hour)""", "series")
def hourly_grid(spark, d):
    x = s.series(spark, d).select("hour", "ws")
    span = x.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return grid.join(x, "hour", "left").select("hour", c.rounded("ws").alias("ws"), F.col("ws").isNull().alias("gap"))


@query("session_windows", f"""WITH x AS (SELECT station, time, ws, CASE WHEN date_diff('microsecond', lag(time) OVER (PARTITION BY station ORDER BY time), time) < 600000000 THEN 0 ELSE 1 END AS new FROM obs),
y AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY time ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT station, min(time) AS start, count(*) AS n, {r6('max(ws)')} AS peak FROM y GROUP BY station, g""", "obs")
def session_windows(spark, d):
    """Events of a station that follow one another within ten minutes, by Spark's own session window."""
    o = s.obs(spark, d).withColumn("ts", F.col("time").cast("timestamp"))
    g = o.groupBy("station", F.session_window("ts", "10 minutes").alias("w")).agg(F.min("time").alias("start"), F.count("*").alias("n"), c.rounded(F.max("ws")).alias("peak"))
    return g.select("station", "start", "n", "peak")


SLOT_BIN = "CASE WHEN ws < 20 THEN 1 WHEN ws < 40 THEN 2 WHEN ws < 80 THEN 3 ELSE 4 END"


@query("rose_slots", f"SELECT hour(time) // 3 AS slot, {sector_sql(8)} AS sector, CAST({SLOT_BIN} AS BIGINT) AS bin, count(*) AS n, {r6('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY hour(time) // 3)')} AS pct, {r6('avg(ws)')} AS mean_ws FROM obs GROUP BY 1, 2, 3", "obs")
def rose_slots(spark, d):
    """Roses of the eight three-hour slots of the day."""
    slotted = s.obs(spark, d).withColumn("slot", F.floor(F.hour("time") / 3))
    rose = wind.wind_rose(slotted, 8, (0.0, 20.0, 40.0, 80.0), by=("slot",))
    return rose.select("slot", "sector", "bin", "n", c.rounded("pct").alias("pct"), c.rounded("mean_ws").alias("mean_ws"))


@query("slot_summary", f"SELECT hour(time) // 2 AS slot, {dirs()}, {r6('avg(ws)')} AS mean_ws, {r6('sqrt(pow(avg(-ws * sin(radians(wd))), 2) + pow(avg(-ws * cos(radians(wd))), 2)) / avg(ws)')} AS constancy FROM obs GROUP BY 1", "obs")
def slot_summary(spark, d):
    """Mean direction, speed and constancy of the twelve two-hour slots."""
    uv = s.obs(spark, d).withColumns({"u": c.wind_u("wd", "ws"), "v": c.wind_v("wd", "ws")})
    return uv.groupBy(F.floor(F.hour("time") / 2).alias("slot")).agg(*wind.direction_summary(), c.rounded(F.avg("ws")).alias("mean_ws"), c.rounded(c.constancy("u", "v")).alias("constancy"))


@query("cloud_ensemble_json", f"SELECT station, to_json({{'n': count(*), 'mean': round(avg(cloud), 3)}}) AS value FROM obs GROUP BY 1", "obs")
def cloud_ensemble_json(spark, d):
    """Nested report rows as JSON text."""
    g = s.obs(spark, d).groupBy("station").agg(F.count("*").alias("n"), F.round(F.avg("cloud"), 3).alias("mean"))
    return g.select("station", F.to_json(F.struct("n", "mean")).alias("value"))
