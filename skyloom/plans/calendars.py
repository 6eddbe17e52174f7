"""Queries over calendars and rule tables, driven by the dates and keys of the bundled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import blending
from skyloom.operators import calendars as cal
from skyloom.functions import columns as c
from skyloom.plans.observations import r6
from skyloom.plans.registry import query
from skyloom.sources import surrogate as s


def r8(x: str) -> str:
    return f"round({x}, 10) + 0.0"


def values(rows) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else "[" + ", ".join(f"{v!r}::DOUBLE" for v in x) + "]" if isinstance(x, (list, tuple)) else str(x)
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


YEARS = "years AS (SELECT DISTINCT py FROM daily)"
LEAP = "(({0} % 4 = 0 AND {0} % 100 <> 0) OR {0} % 400 = 0)"
MUSIM = "list_value(" + ", ".join(f"'{m}'" for m in cal.MUSIM) + ")[(mangsa - 1) // 3 + 1]"
TRAD = f"""{YEARS}, m(mangsa, name, month, day, days, first) AS (VALUES {values(cal.MANGSA)}), o AS (SELECT *, py + CASE WHEN month > 6 OR (month = 6 AND day >= 22) THEN 0 ELSE 1 END AS own FROM years, m),
trad AS (SELECT py, mangsa, name, {MUSIM} AS musim, make_date(own, month, day) AS start, days + CASE WHEN mangsa = 8 AND {LEAP.format('own')} THEN 1 ELSE 0 END AS days FROM o)"""


@query("calendar_traditional", f"WITH {TRAD} SELECT py, mangsa, name, musim, start, start + CAST(days - 1 AS INT) AS stop, days FROM trad", "daily")
def calendar_traditional(spark, d):
    return cal.traditional(s.daily(spark, d).select("py").distinct())


_OLD = (0, 88, 183, 277, 365)
STARTS = [(k, no, float(st[(no - 1) // 3] + (first - _OLD[(no - 1) // 3]) / (_OLD[(no - 1) // 3 + 1] - _OLD[(no - 1) // 3]) * ((*st[1:], 365 + st[0])[(no - 1) // 3] - st[(no - 1) // 3]))) for k, st, *_ in cal.SCENARIOS for no, *_r, first in cal.MANGSA]
CALIB = f"""{YEARS}, f(scenario, mangsa, first) AS (VALUES {values(STARTS)}), n AS (SELECT *, lead(first) OVER (PARTITION BY scenario ORDER BY mangsa) AS next, first_value(first) OVER (PARTITION BY scenario ORDER BY mangsa) AS again FROM f),
calib AS (SELECT scenario, py, mangsa, first, make_date(CAST(py AS INT), 6, 22) + CAST(round_even(first, 0) AS INT) AS start, CASE WHEN next IS NOT NULL THEN make_date(CAST(py AS INT), 6, 22) + CAST(round_even(next, 0) AS INT) ELSE make_date(CAST(py AS INT) + 1, 6, 22) + CAST(round_even(again, 0) AS INT) END AS nxt FROM years, n)"""


@query("calendar_calibrated", f"WITH {CALIB} SELECT scenario, py, mangsa, start, nxt - 1 AS stop, CAST(nxt - start AS BIGINT) AS days, {r6('first')} AS first FROM calib", "daily")
def calendar_calibrated(spark, d):
    return cal.calibrated(s.daily(spark, d).select("py").distinct())


@query("scenario_shift_pivot", f"WITH {TRAD}, c2 AS (SELECT c.*, t.start AS t0 FROM ({CALIB.split(', f(', 1)[1].join(['SELECT * FROM (WITH f(', ' SELECT * FROM calib)'])}) c JOIN trad t USING (py, mangsa)) SELECT py, mangsa, " + ", ".join(f"max(CAST(start - t0 AS BIGINT)) FILTER (scenario = '{k}') AS shift_{k}" for k, *_ in cal.SCENARIOS) + " FROM c2 GROUP BY 1, 2", "daily")
def scenario_shift_pivot(spark, d):
    """Days by which each scenario's mangsa begin later than in the traditional calendar, one column a scenario."""
    years = s.daily(spark, d).select("py").distinct()
    t = cal.traditional(years).select("py", "mangsa", F.col("start").alias("t0"))
    x = cal.calibrated(years).join(t, ["py", "mangsa"]).withColumn("shift", F.datediff("start", "t0").cast("long"))
    return x.groupBy("py", "mangsa").agg(*[F.max(F.when(F.col("scenario") == k, F.col("shift"))).alias(f"shift_{k}") for k, *_ in cal.SCENARIOS])


@query("season_durations", f"WITH {CALIB} SELECT scenario, py, {MUSIM} AS musim, CAST(sum(nxt - start) AS BIGINT) AS days FROM calib GROUP BY 1, 2, 3", "daily")
def season_durations(spark, d):
    return cal.calibrated(s.daily(spark, d).select("py").distinct()).groupBy("scenario", "py", cal.musim_name(F.col("mangsa")).alias("musim")).agg(F.sum("days").alias("days"))


@query("mangsa_of_date", f"WITH {TRAD} SELECT date, CAST(mangsa AS BIGINT) AS mangsa FROM daily JOIN trad ON trad.py = daily.py AND date >= start AND date < start + CAST(days AS INT)", "daily")
def mangsa_of_date(spark, d):
    return cal.mangsa_of_dates(s.daily(spark, d).select("date"))


SPANS = "spans AS (SELECT c_custkey AS id, CAST(c_custkey % 300 AS DOUBLE) + 19 AS s, CAST(c_custkey % 300 AS DOUBLE) + 29 + c_custkey % 60 AS e, ['NETRAL', 'ELNINO', 'LANINA'][1 + c_custkey % 3] AS enso, ['NETRAL', 'pIOD', 'nIOD'][1 + (c_custkey // 3) % 3] AS iod FROM customer)"


def spans(spark, d):
    k = F.col("c_custkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return s.table(spark, d, "customer").select(k.alias("id"), ((k % 300).cast("double") + 19).alias("s"), ((k % 300).cast("double") + 29 + k % 60).alias("e"), pick(("NETRAL", "ELNINO", "LANINA"), k % 3).alias("enso"), pick(("NETRAL", "pIOD", "nIOD"), F.floor(k / 3) % 3).alias("iod"))


CLIMATE = [(i + 1, *map(float, cal.DAILY[i]), cal.ENSO_WARM[i], cal.ENSO_COLD[i], cal.IOD_POSITIVE.get(i + 1, (0.0,) * 6), cal.IOD_NEGATIVE.get(i + 1, (0.0,) * 6), *cal.EXTREMES[i]) for i in range(12)]
_N = ("tx", "tn", "rain", "et0", "rad", "rh")
OVERLAP = f"{SPANS}, r(mangsa, lo, hi) AS (VALUES {values(cal.RANGES)}), ow AS (SELECT *, over / sum(over) OVER (PARTITION BY id) AS w FROM (SELECT spans.*, r.*, least(e, hi) - greatest(s, lo) AS over FROM spans, r WHERE least(e, hi) - greatest(s, lo) > 0))"
CLIM_SQL = f"""WITH {OVERLAP}, cl(mangsa, {', '.join(cal.DAILY_FIELDS)}, warm, cold, pos, neg, x_max, x_min) AS (VALUES {values(CLIMATE)}),
g AS (SELECT id, s, e, enso, iod, {', '.join(f'sum(w * {f}) AS {f}' for f in cal.DAILY_FIELDS if f not in ('rain', 'wet_days'))}, sum(w * wet_days / (hi - lo)) AS wet, sum(CASE WHEN mangsa BETWEEN 3 AND 5 THEN w ELSE 0 END) AS part,
  {', '.join(f"sum(w * CASE enso WHEN 'ELNINO' THEN warm[{i + 1}] WHEN 'LANINA' THEN cold[{i + 1}] ELSE 0 END) AS d_{n}, sum(CASE WHEN mangsa BETWEEN 3 AND 5 THEN w * CASE iod WHEN 'pIOD' THEN pos[{i + 1}] WHEN 'nIOD' THEN neg[{i + 1}] ELSE 0 END ELSE 0 END) AS i_{n}" for i, n in enumerate(_N))},
  max(x_max) AS x_max, min(x_min) AS x_min FROM ow JOIN cl USING (mangsa) GROUP BY ALL),
h AS (SELECT *, greatest(e - s, 1.0) AS dur, CASE WHEN part > 0 AND part * (e - s) >= 15 THEN (CASE WHEN (enso = 'ELNINO' AND iod = 'pIOD') OR (enso = 'LANINA' AND iod = 'nIOD') THEN 0.5 ELSE 0.3 END) / part ELSE 0 END AS share FROM g),
k AS (SELECT *, round_even(wet * dur, 0) AS wet0, rain_d + d_rain AS rain1, rain_d + d_rain + share * i_rain AS rain2 FROM h),
l AS (SELECT *, CASE WHEN enso <> 'NETRAL' AND rain_d > 0.05 THEN greatest(0, round_even(wet0 * pow(greatest(rain1, 0) / rain_d, 0.6), 0)) ELSE wet0 END AS wet1 FROM k),
m AS (SELECT *, CASE WHEN share > 0 AND iod <> 'NETRAL' AND rain1 > 0.05 THEN greatest(0, round_even(wet1 * pow(greatest(rain2, 0) / rain1, 0.6), 0)) ELSE wet1 END AS wet2, et0 + d_et0 + share * i_et0 AS et FROM l)
SELECT id, round_even(rain2 * dur, 0) AS rain, {r8('rain2')} AS rain_d, CAST(wet2 AS BIGINT) AS wet_days, {r8('et')} AS et0, {r8("CASE WHEN enso <> 'NETRAL' OR (share > 0 AND iod <> 'NETRAL') THEN rain2 - et ELSE balance END")} AS balance, {r8('soil')} AS soil, {r8('rh + d_rh + share * i_rh')} AS rh,
  {r8('t_max + d_tx + share * i_tx')} AS t_max, {r8('t_min + d_tn + share * i_tn')} AS t_min, {r8('wind')} AS wind, {r8('rad + d_rad + share * i_rad')} AS rad, x_max, x_min FROM m"""


@query("span_climatology", CLIM_SQL)
def span_climatology(spark, d):
    return cal.span_climatology(spans(spark, d))


@query("overlap_weights", f"WITH {OVERLAP} SELECT id, CAST(mangsa AS BIGINT) AS mangsa, {r6('w')} AS w FROM ow")
def overlap_weights(spark, d):
    return cal.overlap_weights(spans(spark, d)).select("id", F.col("mangsa").cast("long").alias("mangsa"), c.rounded("w").alias("w"))


@query("astro_markers", f"WITH {SPANS}, k(key, pos) AS (VALUES {values([(a, float(b)) for a, b, *_ in cal.MARKERS])}) SELECT id, coalesce(string_agg(key, ',' ORDER BY key), '') AS markers, count(key) AS n FROM spans LEFT JOIN k ON pos BETWEEN s AND e OR pos + 365 BETWEEN s AND e GROUP BY 1")
def astro_markers(spark, d):
    return cal.markers_in(spans(spark, d))


JY = f"""jy AS (SELECT y AS jyear, coalesce(sum(len) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, len FROM (SELECT y, [{', '.join(map(str, cal.YEAR_LENGTHS))}][1 + (y - 1555) % 8] - CASE WHEN y IN {cal.SHORTENED} THEN 1 ELSE 0 END AS len FROM (SELECT unnest(generate_series(1555, 2586)) AS y))),
jm AS (SELECT jyear, m, first + (m // 2) * 59 + (m % 2) * 30 AS a, CASE WHEN m = 11 THEN len - 325 WHEN m % 2 = 0 THEN 30 ELSE 29 END AS n FROM jy, (SELECT unnest(generate_series(0, 11)) AS m))"""


def names(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


@query("javanese_date", f"""WITH {JY}, x AS (SELECT date, CAST(date - DATE '{cal.EPOCH}' AS BIGINT) AS d FROM daily)
SELECT date, jyear, {names(cal.YEAR_NAMES)}[1 + (jyear - 1555) % 8] AS year_name, {names(cal.MONTH_NAMES)}[m + 1] AS month, CAST(d - a + 1 AS BIGINT) AS day, {names(cal.DAY_NAMES)}[1 + (d + 5) % 7] AS dina, {names(cal.MARKET_DAYS)}[1 + d % 5] AS pasaran, {names(cal.SIX_DAYS)}[1 + (d + 2) % 6] AS paringkelan,
  ((d + 194) // 7) % 30 + 1 AS wuku, ((d + 311) // 35) % 12 + 1 AS masa_wuku, ((jyear - 1555 + 7) // 8) % 4 + 1 AS windu, CAST(CASE {' '.join(f'WHEN jyear BETWEEN {a} AND {b} THEN {n}' for a, b, n in cal.KURUP)} END AS BIGINT) AS kurup FROM x JOIN jm ON d >= a AND d < a + n""", "daily")
def javanese_date(spark, d):
    return cal.javanese(s.daily(spark, d).select("date"))


@query("javanese_inverse", f"WITH {JY}, x AS (SELECT c_custkey AS id, 1900 + c_custkey % 80 AS jyear, c_custkey % 13 AS month_no, c_custkey % 31 AS day FROM customer) SELECT id, x.jyear, month_no, day, CASE WHEN day >= 1 AND day <= n THEN DATE '{cal.EPOCH}' + CAST(a + day - 1 AS INT) END AS date FROM x LEFT JOIN jm ON jm.jyear = x.jyear AND m = month_no")
def javanese_inverse(spark, d):
    k = F.col("c_custkey")
    return cal.from_javanese(s.table(spark, d, "customer").select(k.alias("id"), (1900 + k % 80).alias("jyear"), (k % 13).alias("month_no"), (k % 31).alias("day")))


@query("suwung_months", f"""WITH {JY}, own AS (SELECT DISTINCT jyear FROM daily JOIN jm ON CAST(date - DATE '{cal.EPOCH}' AS BIGINT) >= a AND CAST(date - DATE '{cal.EPOCH}' AS BIGINT) < a + jm.n), days AS (SELECT jyear, m, unnest(generate_series(CAST(a AS BIGINT), CAST(a + n - 1 AS BIGINT))) AS d FROM jm JOIN own USING (jyear))
SELECT jyear, {names(cal.MONTH_NAMES)}[m + 1] AS month FROM days GROUP BY jyear, m HAVING count(*) FILTER ((d + 5) % 7 = 2 AND d % 5 = 4) = 0""", "daily")
def suwung_months(spark, d):
    """Months without the pair of days, in the years that the table's dates fall in."""
    return cal.months_without(cal.javanese(s.daily(spark, d).select("date")).select(F.col("jyear").cast("int").alias("jyear")).distinct())


@query("hari_baik", f"""WITH w(dina, a) AS (VALUES {values(cal.WEEKDAY_NUMBERS)}), p(pasaran, b) AS (VALUES {values(cal.MARKET_NUMBERS)}), nv(dina, pasaran) AS (VALUES {values(cal.NEVER)}), x AS (SELECT c_custkey AS id, c_custkey % 29 + 14 AS total FROM customer)
SELECT id, dina, pasaran, CAST(a + b AS BIGINT) AS neptu FROM x, w, p WHERE (a + b) % 3 = CASE total % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AND NOT EXISTS (SELECT 1 FROM nv WHERE nv.dina = w.dina AND nv.pasaran = p.pasaran)""")
def hari_baik(spark, d):
    k = F.col("c_custkey")
    return cal.good_days(s.table(spark, d, "customer").select(k.alias("id"), (k % 29 + 14).alias("total")))


POINTS = "pt AS (SELECT s_suppkey AS id, -7.52 + (s_suppkey % 17 - 8) * 0.01 AS t_lat, 110.22 + (s_suppkey % 13 - 6) * 0.01 AS t_lon, -7.5149 AS s1_lat, 110.1752 AS s1_lon, -7.55 AS s2_lat, 110.24 AS s2_lon, 10.0 + s_suppkey % 30 AS decor, 1.0 + (s_suppkey % 5) / 2.0 AS power FROM supplier)"


def points(spark, d):
    k = F.col("s_suppkey")
    return s.table(spark, d, "supplier").select(
        k.alias("id"), (-7.52 + (k % 17 - 8) * 0.01).alias("t_lat"), (110.22 + (k % 13 - 6) * 0.01).alias("t_lon"), F.lit(-7.5149).alias("s1_lat"), F.lit(110.1752).alias("s1_lon"), F.lit(-7.55).alias("s2_lat"), F.lit(110.24).alias("s2_lon"), (10.0 + k % 30).alias("decor"), (1.0 + (k % 5) / 2.0).alias("power")
    )


def hav(a: str, b: str) -> str:
    return f"2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin(radians({b}_lat - {a}_lat) / 2), 2) + cos(radians({a}_lat)) * cos(radians({b}_lat)) * pow(sin(radians({b}_lon - {a}_lon) / 2), 2), 0), 1)))"


@query("haversine_idw_weights", f"WITH {POINTS}, x AS (SELECT id, {hav('t', 's1')} AS d1, {hav('t', 's2')} AS d2 FROM pt) SELECT id, {r6('d1')} AS d1, {r6('d2')} AS d2, {r6('pow(d1, -2) / (pow(d1, -2) + pow(d2, -2))')} AS w1, {r6('1 - pow(d1, -2) / (pow(d1, -2) + pow(d2, -2))')} AS w2 FROM x")
def haversine_idw_weights(spark, d):
    x = blending.baseline(points(spark, d))
    w1, w2 = blending.inverse_distance_weights(F.col("d1"), F.col("d2"))
    return x.select("id", c.rounded("d1").alias("d1"), c.rounded("d2").alias("d2"), c.rounded(w1).alias("w1"), c.rounded(w2).alias("w2"))


@query("gidw_weights", f"""WITH {POINTS}, a AS (SELECT *, radians(s2_lon - s1_lon) * 6371.0088 * cos(radians(s1_lat)) AS bx, radians(s2_lat - s1_lat) * 6371.0088 AS by_, radians(t_lon - s1_lon) * 6371.0088 * cos(radians(s1_lat)) AS tx, radians(t_lat - s1_lat) * 6371.0088 AS ty, {hav('t', 's1')} AS d1, {hav('t', 's2')} AS d2 FROM pt),
b AS (SELECT *, least(greatest((tx * bx + ty * by_) / (bx * bx + by_ * by_), 0), 1) AS along FROM a), e AS (SELECT *, sqrt(pow(tx - along * bx, 2) + pow(ty - along * by_, 2)) AS across FROM b), f AS (SELECT *, exp(-across / greatest(decor / 4, 0.1)) AS alpha, pow(d1, -power) / (pow(d1, -power) + pow(d2, -power)) AS idw1 FROM e)
SELECT id, {r6('along')} AS along, {r6('across')} AS across, {r6('alpha')} AS alpha, {r6('alpha * (1 - along) + (1 - alpha) * idw1')} AS w1 FROM f""")
def gidw_weights(spark, d):
    return blending.gradient_weights(blending.baseline(points(spark, d)), "decor", "power").select("id", *[c.rounded(x).alias(x) for x in ("along", "across", "alpha", "w1")])


@query("lapse_pressure", f"WITH m AS (SELECT avg(cloud) + 273.15 AS t FROM obs) SELECT event_id, round(ws - 0.0065 * 120, 9) AS lapse, round(gust * (1 - 9.80665 * 120 / (287.05 * t)), 7) AS pressure FROM obs, m", "obs")
def lapse_pressure(spark, d):
    """Corrections for height; the mean temperature is a one-row table."""
    o = s.obs(spark, d)
    m = o.agg((F.avg("cloud") + 273.15).alias("t"))
    return o.crossJoin(F.broadcast(m)).select("event_id", F.round(blending.lapse_corrected("ws", 0.0065, 120), 9).alias("lapse"), F.round(blending.pressure_at("gust", 120, F.col("t")), 7).alias("pressure"))


@query("blend_classes", f"""WITH p AS (SELECT a.hour, a.wd AS d1, b.wd AS d2, floor(a.cloud / 20) AS c1, floor(b.cloud / 20) AS c2 FROM hourly a JOIN hourly b ON a.hour = b.hour WHERE a.station = 0 AND b.station = 1)
SELECT hour, round(degrees(acos(least(sqrt(pow(0.4154 * cos(radians(d1)) + 0.5846 * cos(radians(d2)), 2) + pow(0.4154 * sin(radians(d1)) + 0.5846 * sin(radians(d2)), 2)), 1.0))), 4) + 0.0 AS sigma, CAST(coalesce(c2, c1) AS BIGINT) AS category FROM p""", "hourly")
def blend_classes(spark, d):
    """Spread of a blended direction, and a category by the heavier station."""
    a, b = blending.split(s.hourly(spark, d))
    w1, w2 = blending.VOLATILE
    t1, t2 = F.radians(F.col("wd_1")), F.radians(F.col("wd_2"))
    r = F.hypot(w1 * F.cos(t1) + w2 * F.cos(t2), w1 * F.sin(t1) + w2 * F.sin(t2))
    x = a.join(b, "hour").withColumns({"k1": F.floor(F.col("cloud_1") / 20), "k2": F.floor(F.col("cloud_2") / 20)})
    return x.select("hour", c.rounded(blending.circular_sigma(r), 4).alias("sigma"), blending.winner("k1", "k2", w1, w2).cast("long").alias("category"))


_RULES = ", ".join(f"({i}, '{rule}')" for i, (_, rule) in enumerate(cal.MONTH_RULES) if rule in ("baik", "boleh"))


@query("good_months", f"WITH {JY}, x AS (SELECT m, count(*) AS days FROM daily JOIN jm ON CAST(date - DATE '{cal.EPOCH}' AS BIGINT) >= a AND CAST(date - DATE '{cal.EPOCH}' AS BIGINT) < a + jm.n GROUP BY 1) SELECT {names([n for n, _ in cal.MONTH_RULES])}[m + 1] AS month, rule, days FROM x JOIN (VALUES {_RULES}) r(k, rule) ON k = m", "daily")
def good_months(spark, d):
    """Days of the table in each month that is good or allowed: months meet their rules by number."""
    number = F.array_position(F.array(*[F.lit(n) for n in cal.MONTH_NAMES]), F.col("jmonth"))
    days = cal.javanese(s.daily(spark, d).select("date")).withColumnRenamed("month", "jmonth").groupBy(F.element_at(F.array(*[F.lit(n) for n, _ in cal.MONTH_RULES]), number.cast("int")).alias("month")).agg(F.count("*").alias("days"))
    return days.join(F.broadcast(cal.good_months(spark, only_good=False)), "month").select("month", "rule", "days")


@query("excluded_days", f"""WITH w(dina, a) AS (VALUES {values(cal.WEEKDAY_NUMBERS)}), p(pasaran, b) AS (VALUES {values(cal.MARKET_NUMBERS)}), x AS (SELECT {names([n for n, _ in cal.WEEKDAY_NUMBERS])}[c_custkey % 7 + 1] AS dina, {names([n for n, _ in cal.MARKET_NUMBERS])}[c_custkey % 5 + 1] AS pasaran FROM customer WHERE c_acctbal < -900)
SELECT dina, pasaran, CAST(a + b AS BIGINT) AS neptu FROM w, p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.dina = w.dina AND x.pasaran = p.pasaran)""")
def excluded_days(spark, d):
    """Pairs of days that no customer deep in debt was born on."""
    k = F.col("c_custkey")
    day = lambda table, n: F.element_at(F.array(*[F.lit(x) for x, _ in table]), (k % n + 1).cast("int"))
    gone = s.table(spark, d, "customer").where("c_acctbal < -900").select(day(cal.WEEKDAY_NUMBERS, 7).alias("dina"), day(cal.MARKET_NUMBERS, 5).alias("pasaran"))
    return cal.without(cal.day_pairs(spark), gone).select("dina", "pasaran", F.col("neptu").cast("long").alias("neptu"))


@query("windu_progress", f"WITH {JY}, w AS (SELECT (jyear - 1555) // 8 AS w, min(jyear) AS windu_year, min(first) AS a, sum(len) AS n FROM jy GROUP BY 1), x AS (SELECT date, CAST(date - DATE '{cal.EPOCH}' AS BIGINT) AS d FROM daily) SELECT date, windu_year, CAST(d - a AS BIGINT) AS days, CAST(((d - a) // 35) % 81 + 1 AS BIGINT) AS lapan, {r6('100.0::DOUBLE * (d - a) / n')} AS percent FROM x JOIN w ON d >= a AND d < a + n", "daily")
def windu_progress(spark, d):
    return cal.windu_progress(s.daily(spark, d).select("date"))
