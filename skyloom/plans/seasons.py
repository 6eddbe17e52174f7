"""Queries of seasons: hidden states, low-passed vectors, climate context and spaced onsets of several places."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.functions import significance, tables
from skyloom.operators import climate, extremes, hidden, vector_phase
from skyloom.operators.calendars import SCENARIOS
from skyloom.operators.detectors import lanczos_kernel
from skyloom.plans.calendars import CALIB
from skyloom.plans.registry import query
from skyloom.sources import surrogate as s

NAMES = tuple(f.name for f in hidden.FOUR)


def place_features(spark, d):
    """The rolled features of each region, and of all together as place -1."""
    fields = ["place", "date", *[f.field for f in hidden.FOUR]]
    return hidden.rolled(s.places(spark, d).select(*fields).unionByName(s.climate(spark, d).withColumn("place", F.lit(-1).cast("long")).select(*fields)), hidden.FOUR)


def place_model(features) -> hidden.Model:
    return hidden.estimated(features, NAMES, hidden.labelled(c.season_day("date")))


@query("hidden_season")
def hidden_season(spark, d):
    """Onset and offset of each place and year from four hidden states on four rolled features; the model is estimated from all days."""
    features = place_features(spark, d)
    found = hidden.seasons(hidden.posteriors(features, place_model(features)))
    return found.select("place", "py", "onset", "offset", (F.col("offset") - F.col("onset")).alias("duration"))


TAPS = ", ".join(f"{w!r}::DOUBLE" for w in lanczos_kernel(vector_phase.TAPS, 1.0 / vector_phase.CUTOFF_DAYS))
HALF = vector_phase.TAPS // 2
LOW = f"""k AS (SELECT unnest(generate_series({-HALF}, {HALF})) AS off, unnest([{TAPS}]) AS w), r AS (SELECT place, date, u_comp AS u, du AS v, row_number() OVER (PARTITION BY place ORDER BY date) AS rn FROM places),
low AS (SELECT a.place, a.date, a.rn, sum(b.u * k.w) AS u, sum(b.v * k.w) AS v FROM r a JOIN k ON true JOIN r b ON b.place = a.place AND b.rn = a.rn - k.off GROUP BY 1, 2, 3)"""


@query("vector_phase", f"""WITH {LOW}, d AS (SELECT *, (degrees(atan2(u, v)) + 180 + 360) % 360 AS direction FROM low), t AS (SELECT *, direction - lag(direction) OVER w AS step FROM d WINDOW w AS (PARTITION BY place ORDER BY date))
SELECT place, date, round(u, 9) AS u, round(v, 9) AS v, round(direction, 6) AS direction, round(direction + 360 * sum(CASE WHEN step > 180 THEN -1 WHEN step < -180 THEN 1 ELSE 0 END) OVER (PARTITION BY place ORDER BY date), 6) AS turned FROM t""", "places")
def vector_phase_days(spark, d):
    """The wind vector of each place behind a low-pass of 241 days, its direction and how far it has turned."""
    low = vector_phase.low_passed(s.places(spark, d), ("u_comp", "du"), "place")
    return vector_phase.with_direction(low, "low_u_comp", "low_du", "place").select("place", "date", F.round("low_u_comp", 9).alias("u"), F.round("low_du", 9).alias("v"), F.round("direction", 6).alias("direction"), F.round("turned", 6).alias("turned"))


@query("vector_phase_onset", f"""WITH {LOW}, y AS (SELECT *, {s.PY} AS py FROM low), x AS (SELECT *, CAST(date - make_date(CAST(py AS INT), 6, 22) AS BIGINT) % 365 AS dopy, lag(u) OVER w AS prev, lead(date) OVER w AS more FROM y WINDOW w AS (PARTITION BY place, py ORDER BY date)),
g AS (SELECT place, py, count(*) AS n, count(*) FILTER (dopy BETWEEN 60 AND 120) AS n_dry, count(*) FILTER (dopy BETWEEN 180 AND 280) AS n_wet, min(u) FILTER (dopy BETWEEN 60 AND 120) AS a, max(u) FILTER (dopy BETWEEN 180 AND 280) AS b FROM x GROUP BY 1, 2),
l AS (SELECT place, py, CASE WHEN n >= 60 AND n_dry >= 10 AND n_wet >= 10 AND b - a >= 0.05 THEN CASE WHEN b - a < 0.15 THEN 0.02 ELSE a + 0.2 * (b - a) END END AS threshold FROM g),
c AS (SELECT x.*, coalesce(p.amplitude >= 2.0, false) AS active FROM x JOIN l USING (place, py) LEFT JOIN phase_days p ON p.date = x.date WHERE dopy BETWEEN 60 AND 200 AND more IS NOT NULL AND prev < threshold AND u >= threshold),
o AS (SELECT place, py, arg_min(dopy, date) FILTER (NOT active) AS onset, min(date) FILTER (NOT active) AS first FROM c GROUP BY 1, 2)
SELECT l.place, CAST(l.py AS BIGINT) AS py, round(threshold, 9) AS threshold, onset, (SELECT count(*) FROM c WHERE c.place = l.place AND c.py = l.py AND c.active AND (o.first IS NULL OR c.date < o.first)) AS gated FROM l LEFT JOIN o ON o.place = l.place AND o.py = l.py""", "places", "phase_days")
def vector_phase_onset(spark, d):
    """First upward crossing of the recovery threshold that no run of active phase-index days covers."""
    low = vector_phase.low_passed(s.places(spark, d), ("u_comp",), "place")
    return vector_phase.onsets(low, s.phase_days(spark, d), "low_u_comp", "place").select("place", "py", F.round("threshold", 9).alias("threshold"), "onset", "gated")


def context(spark, d):
    x = s.daily(spark, d)
    sst, sla = x.select("date", ((F.col("v") - 140) / 8).alias("value")), x.select("date", (F.col("n") - 6).cast("double").alias("value"))
    w = s.daily2(spark, d)
    weekly = w.groupBy(F.trunc("date", "month").alias("month")).agg(F.avg(F.col("w") - 38).alias("value"))
    return climate.context(x.select("py").distinct(), sst, sla, climate.first_source(weekly, weekly.limit(0)), s.phase_days(spark, d))


CONTEXT = """y AS (SELECT DISTINCT py FROM daily), m AS (SELECT year(date) AS py, avg((v - 140) / 8) FILTER (month(date) BETWEEN 8 AND 10) AS sst_aso, avg(n - 6) FILTER (month(date) BETWEEN 8 AND 10) AS sla_aso FROM daily GROUP BY 1),
dm AS (SELECT date_trunc('month', date) AS month, avg(w - 38) AS value FROM daily2 GROUP BY 1), ds AS (SELECT year(month) AS py, avg(value) AS dmi_son FROM dm WHERE month(month) BETWEEN 9 AND 11 GROUP BY 1),
ph AS (SELECT *, row_number() OVER (ORDER BY date) AS rn, phase BETWEEN 5 AND 8 AND amplitude >= 1.5 AS active FROM phase_days),
i AS (SELECT y.py, ph.*, rn - row_number() OVER (PARTITION BY y.py, active ORDER BY rn) AS g FROM y JOIN ph ON ph.date BETWEEN make_date(CAST(y.py AS INT), 6, 22) + 100 AND make_date(CAST(y.py AS INT), 6, 22) + 195),
ev AS (SELECT py, count(*) AS n_events, max(len) AS max_run FROM (SELECT py, g, count(*) AS len FROM i WHERE active GROUP BY 1, 2) WHERE len >= 5 GROUP BY 1), da AS (SELECT py, count(*) FILTER (active) AS active_days, max(amplitude) AS peak_amp FROM i GROUP BY 1),
ld AS (SELECT y.py, bool_or(active) AS lead_flag FROM y JOIN ph ON ph.date BETWEEN make_date(CAST(y.py AS INT), 6, 22) + 85 AND make_date(CAST(y.py AS INT), 6, 22) + 93 GROUP BY 1),
j AS (SELECT y.py, sst_aso, sla_aso, dmi_son, coalesce(active_days, 0) AS active_days, coalesce(n_events, 0) AS n_events, coalesce(max_run, 0) AS max_run, peak_amp, coalesce(lead_flag, false) AS lead_flag,
  CASE WHEN sst_aso >= 0.5 THEN 'ELNINO' WHEN sst_aso <= -0.5 THEN 'LANINA' ELSE 'NETRAL' END AS enso, CASE WHEN dmi_son >= 0.4 THEN 'pIOD' WHEN dmi_son <= -0.4 THEN 'nIOD' ELSE 'NETRAL' END AS iod FROM y LEFT JOIN m USING (py) LEFT JOIN ds USING (py) LEFT JOIN da USING (py) LEFT JOIN ev USING (py) LEFT JOIN ld USING (py)),
ctx AS (SELECT *, CASE WHEN (enso = 'ELNINO' AND iod = 'pIOD') OR (enso = 'LANINA' AND iod = 'nIOD') THEN 'SINERGI' WHEN (enso = 'ELNINO' AND iod = 'nIOD') OR (enso = 'LANINA' AND iod = 'pIOD') THEN 'COUNTER' ELSE 'NETRAL' END AS interaction,
  least(0.95, 0.5 + CASE WHEN lead_flag THEN 0.15 ELSE 0 END + CASE WHEN n_events >= 2 THEN 0.1 WHEN n_events = 1 THEN 0.05 ELSE 0 END) AS odds FROM j)"""


@query("climate_context", f"""WITH {CONTEXT} SELECT CAST(py AS BIGINT) AS py, round(sst_aso, 9) AS sst_aso, round(sla_aso, 9) AS sla_aso, round(dmi_son, 9) AS dmi_son, enso, iod, interaction, CAST(active_days AS BIGINT) AS active_days, CAST(n_events AS BIGINT) AS n_events,
  CAST(max_run AS BIGINT) AS max_run, round(peak_amp, 9) AS peak_amp, lead_flag, round(odds, 6) AS odds FROM ctx""", "daily", "daily2", "phase_days")
def climate_context(spark, d):
    """Index means and classes of each year, and the phase index in its onset and lead windows."""
    x = context(spark, d)
    return x.select("py", *[F.round(n, 9).alias(n) for n in ("sst_aso", "sla_aso", "dmi_son")], "enso", "iod", "interaction", "active_days", "n_events", "max_run", F.round("peak_amp", 9).alias("peak_amp"), "lead_flag", F.round("odds", 6).alias("odds"))


@query("climate_flags", f"""WITH {CONTEXT}, se AS (SELECT py, CAST(min(dopy) FILTER (v > 165) AS DOUBLE) AS onset, CAST(max(dopy) FILTER (v > 165) - min(dopy) FILTER (v > 165) AS DOUBLE) AS duration FROM daily GROUP BY 1),
sp AS (SELECT median(onset) AS mo, stddev_samp(onset) AS so, median(duration) AS md, stddev_samp(duration) AS sd FROM se),
f AS (SELECT py, coalesce(abs(sst_aso) >= 0.75 AND abs(dmi_son) >= 0.75, false) AS strong, interaction, lead_flag, so > 0 AND abs(onset - mo) > 1.5 * so AS fo, sd > 0 AND abs(duration - md) > 1.5 * sd AS fd FROM ctx LEFT JOIN se USING (py), sp)
SELECT CAST(py AS BIGINT) AS py, coalesce(nullif(concat_ws(' ', CASE WHEN strong AND interaction = 'COUNTER' AND fo THEN 'onset-anomaly' END, CASE WHEN strong AND interaction = 'COUNTER' AND fd THEN 'duration-anomaly' END, CASE WHEN strong AND interaction = 'SINERGI' THEN 'synergy' END, CASE WHEN lead_flag THEN 'lead' END), ''), '-') AS flags FROM f""", "daily", "daily2", "phase_days")
def climate_flags(spark, d):
    """Tokens of strong years that are far off or in synergy, and of an active lead window."""
    high = F.when(F.col("v") > 165, F.col("dopy"))
    seasons = s.daily(spark, d).groupBy("py").agg(F.min(high).cast("double").alias("onset"), (F.max(high) - F.min(high)).cast("double").alias("duration"))
    return climate.flags(context(spark, d), seasons)


@query("spaced_onsets", """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY hour) AS rn, count(*) OVER (PARTITION BY station) AS total FROM hourly),
x AS (SELECT *, max(precip) OVER w AS before, count(precip) OVER w AS k FROM r WINDOW w AS (PARTITION BY station ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), e AS (SELECT station, hour, rn, precip FROM x WHERE precip > 2 AND k = 3 AND before < 2 AND rn <= total - 12),
p AS (SELECT a.station, a.rn, min(b.rn) AS next FROM e a LEFT JOIN e b ON b.station = a.station AND b.rn >= a.rn + 12 GROUP BY 1, 2),
g AS (SELECT station, min(rn) AS rn FROM e GROUP BY 1 UNION ALL SELECT p.station, p.next FROM g JOIN p ON p.station = g.station AND p.rn = g.rn WHERE p.next IS NOT NULL)
SELECT station, hour, CAST(rn AS BIGINT) AS rn, round(precip, 9) AS precip FROM e JOIN g USING (station, rn)""", "hourly")
def spaced_onsets(spark, d):
    """Rain onsets of each station after dry hours, at least twelve rows apart."""
    found = extremes.onsets(s.hourly(spark, d), "precip", "hour", ["station"], dry=3, wet=2.0, dry_below=2.0)
    return found.select("station", "hour", F.col("rn").cast("long").alias("rn"), F.round("precip", 9).alias("precip"))


def _p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t by Simpson's rule over the angle: another way than the plan's."""
    return f"""(SELECT exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * 2 * sum(CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(atan(abs({t}) / sqrt({df})) + (pi() / 2 - atan(abs({t}) / sqrt({df}))) * i / 8000), 0), {df} - 1))
  * (pi() / 2 - atan(abs({t}) / sqrt({df}))) / 8000 / 3 FROM generate_series(0, 8000) q(i))"""


@query("significance", f"""WITH g AS (SELECT py % 2 AS k, avg(v) AS m, var_samp(v) AS s, count(*) AS n FROM daily GROUP BY 1), w AS (SELECT (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS t, pow(a.s / a.n + b.s / b.n, 2) / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1)) AS df FROM g a, g b WHERE a.k = 0 AND b.k = 1),
c AS (SELECT corr(v, w) AS r, count(*) - 2 AS df FROM daily JOIN daily2 USING (date)), y AS (SELECT corr(y, py) AS r, count(*) - 2 AS df FROM (SELECT py, avg(v) AS y FROM daily GROUP BY 1)),
a AS (SELECT 'welch' AS test, t, df::DOUBLE AS df FROM w UNION ALL SELECT 'correlation', r * sqrt(df / (1 - r * r)), df::DOUBLE FROM c UNION ALL SELECT 'trend', r * sqrt(df / (1 - r * r)), df::DOUBLE FROM y)
SELECT test, round(t, 8) AS t, round(df, 6) AS df, round({_p_sql('t', 'df')}, 6) AS p FROM a""", "daily", "daily2")
def significance_of_differences(spark, d):
    """t, degrees of freedom and p of two groups of years, of the correlation of two series, and of the trend over years."""
    x = s.daily(spark, d)
    g = x.agg(*[f(F.when(F.col("py") % 2 == k, F.col("v"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))])
    a, b = F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")
    welch = g.select(F.lit("welch").alias("test"), ((F.col("m0") - F.col("m1")) / F.sqrt(a + b)).alias("t"), (F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n0") - 1) + F.pow(b, 2) / (F.col("n1") - 1))).alias("df"))

    def related(rows, p, q, name):
        r = rows.agg(F.corr(p, q).alias("r"), (F.count("*") - 2).cast("double").alias("df"))
        return r.select(F.lit(name).alias("test"), (F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r")))).alias("t"), "df")

    pairs = related(x.join(s.daily2(spark, d), "date"), "v", "w", "correlation")
    trend = related(x.groupBy("py").agg(F.avg("v").alias("y")), "y", "py", "trend")
    every = welch.unionByName(pairs).unionByName(trend)
    return every.select("test", F.round("t", 8).alias("t"), F.round("df", 6).alias("df"), F.round(significance.t_p_value(F.col("t"), F.col("df")), 6).alias("p"))


@query("calendar_lateral", f"WITH {CALIB} SELECT scenario, py, CAST(mangsa AS BIGINT) AS mangsa, start, nxt - 1 AS stop, CAST(nxt - start AS BIGINT) AS days FROM calib", "daily")
def calendar_lateral(spark, d):
    """The calibrated calendar of every year of the table and every scenario, by the table function under a LATERAL join."""
    tables.register(spark)
    years = s.daily(spark, d).select("py").distinct()
    keys = spark.createDataFrame([(key,) for key, *_ in SCENARIOS], "scenario string")
    out = spark.sql("SELECT c.* FROM {y} y CROSS JOIN {k} k, LATERAL calendar(y.py, k.scenario) c", y=years, k=keys)
    return out.select("scenario", "py", F.col("mangsa").cast("long").alias("mangsa"), "start", "stop", "days")
