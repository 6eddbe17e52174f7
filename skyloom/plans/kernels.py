"""Queries of the sequential and spectral kernels, with recursive SQL where SQL can say them; the others are tested against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators import kernels as k
from skyloom.plans.registry import query
from skyloom.plans.series import INDEX, index
from skyloom.sources import surrogate as s


def biweight_sql(rows: str, value: str, weight: str) -> str:
    """Common table expressions up to `done` (py, ensemble, n): the rounds of the biweight over lists of (value, weight)."""
    return f"""bl AS (SELECT py, coalesce(list({value}::DOUBLE ORDER BY {value}, {weight}) FILTER ({value} IS NOT NULL AND {weight} > 0), []) AS vs, coalesce(list({weight}::DOUBLE ORDER BY {value}, {weight}) FILTER ({value} IS NOT NULL AND {weight} > 0), []) AS ws, count({value}) AS n FROM {rows} GROUP BY py),
bn AS (SELECT py, vs, list_transform(ws, lambda w: w / list_sum(ws)) AS ws, n FROM bl),
bs AS (SELECT *, vs[1 + len(list_filter(range(1, len(ws) + 1), lambda i: list_sum(ws[1:i]) < 0.5))] AS seed FROM bn),
rounds AS (SELECT py, 0 AS k, coalesce(seed, vs[len(vs)]) AS centre, false AS done FROM bs UNION ALL
  SELECT py, k + 1, coalesce(new, centre), new IS NULL OR abs(new - centre) < 0.1 FROM (
    SELECT *, CASE WHEN spread >= 0.5 AND list_sum(bell) >= 1e-10 THEN list_sum(list_transform(range(1, len(vs) + 1), lambda i: bell[i] * vs[i])) / list_sum(bell) END AS new FROM (
      SELECT *, list_transform(range(1, len(vs) + 1), lambda i: ws[i] * pow(greatest(1 - pow((vs[i] - centre) / ({k.BISQUARE} * spread), 2), 0), 2)) AS bell FROM (
        SELECT r.py, r.k, r.centre, b.vs, b.ws, list_aggregate(list_transform(b.vs, lambda v: abs(v - r.centre)), 'median') AS spread FROM rounds r JOIN bs b USING (py) WHERE NOT r.done AND r.k < {k.ROUNDS} AND len(b.vs) >= 4)))),
done AS (SELECT b.py, CASE WHEN len(vs) >= 4 THEN (SELECT arg_max(centre, k) FROM rounds r WHERE r.py = b.py) WHEN len(vs) >= 2 THEN list_sum(list_transform(range(1, len(vs) + 1), lambda i: vs[i] * ws[i])) END AS ensemble, n FROM bs b)"""


TREND = """t AS (SELECT date, v, row_number() OVER (ORDER BY date) AS rn FROM daily),
f AS (SELECT 0::BIGINT AS rn, v AS level, 0.0::DOUBLE AS trend, 20.0::DOUBLE AS a, 0.0::DOUBLE AS b, 20.0::DOUBLE AS c FROM t WHERE rn = 1 UNION ALL
  SELECT rn, l + tr + top * gap * top / (top * top + r), tr + side * gap * top / (top * top + r), top * sqrt(r / (top * top + r)), side * sqrt(r / (top * top + r)), corner FROM (
    SELECT *, sqrt(greatest(b * b + c * c + 0.02 - side * side, 0)) AS corner, greatest(1.0, 5.0 + 0.3 * gap * gap) AS r FROM (
      SELECT *, ((a + b) * b + c * c) / top AS side FROM (
        SELECT t.rn, f.level AS l, f.trend AS tr, f.a, f.b, f.c, sqrt((f.a + f.b) * (f.a + f.b) + f.c * f.c + 0.8) AS top, t.v - (f.level + f.trend) AS gap FROM f JOIN t ON t.rn = f.rn + 1))))"""
#: The same for each place.
PLACE_TREND = """t AS (SELECT place, date, cloud AS v, row_number() OVER (PARTITION BY place ORDER BY date) AS rn FROM places),
f AS (SELECT place, 0::BIGINT AS rn, v AS level, 0.0::DOUBLE AS trend, 20.0::DOUBLE AS a, 0.0::DOUBLE AS b, 20.0::DOUBLE AS c FROM t WHERE rn = 1 UNION ALL
  SELECT place, rn, l + tr + top * gap * top / (top * top + r), tr + side * gap * top / (top * top + r), top * sqrt(r / (top * top + r)), side * sqrt(r / (top * top + r)), corner FROM (
    SELECT *, sqrt(greatest(b * b + c * c + 0.02 - side * side, 0)) AS corner, greatest(1.0, 5.0 + 0.3 * gap * gap) AS r FROM (
      SELECT *, ((a + b) * b + c * c) / top AS side FROM (
        SELECT t.place, t.rn, f.level AS l, f.trend AS tr, f.a, f.b, f.c, sqrt((f.a + f.b) * (f.a + f.b) + f.c * f.c + 0.8) AS top, t.v - (f.level + f.trend) AS gap FROM f JOIN t ON t.place = f.place AND t.rn = f.rn + 1))))"""

HIDDEN = """o AS (SELECT py, date, coalesce(idx, 0) AS x FROM rr), own AS (SELECT py AS slice, date, x, true AS own FROM o UNION ALL SELECT py + 1, date, x, false FROM o WHERE make_date(CAST(py + 1 AS INT), 6, 22) - date <= 180),
c AS (SELECT *, count(*) FILTER (NOT own) OVER (PARTITION BY slice) AS warm, count(*) FILTER (own) OVER (PARTITION BY slice) AS mine FROM own), h AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY date) AS rn FROM c WHERE mine >= 30 AND (warm >= 90 OR own)),
g AS (SELECT slice, rn, date, own, w0 / (w0 + w1) AS p0 FROM (SELECT *, CASE WHEN warm >= 90 THEN 0.5 ELSE 1.0 END * exp(-pow(x + 0.6, 2) / (2 * (0.8 + 1e-6))) AS w0, CASE WHEN warm >= 90 THEN 0.5 ELSE 0.0 END * exp(-pow(x - 0.6, 2) / (2 * (0.8 + 1e-6))) AS w1 FROM h WHERE rn = 1) UNION ALL
  SELECT slice, rn, date, own, w0 / (w0 + w1) FROM (SELECT h.slice, h.rn, h.date, h.own, (0.97 * g.p0 + 0.03 * (1 - g.p0)) * exp(-pow(h.x + 0.6, 2) / (2 * (0.8 + 1e-6))) AS w0, (0.03 * g.p0 + 0.97 * (1 - g.p0)) * exp(-pow(h.x - 0.6, 2) / (2 * (0.8 + 1e-6))) AS w1 FROM g JOIN h ON h.slice = g.slice AND h.rn = g.rn + 1))"""

CENTRED = "a AS (SELECT station, ws - avg(ws) OVER (PARTITION BY station) AS v, row_number() OVER (PARTITION BY station ORDER BY hour) - 1 AS t, count(*) OVER (PARTITION BY station) AS n FROM hourly)"
FOURIER = f"""{CENTRED}, fr AS (SELECT station, any_value(n) AS n, unnest(generate_series(1, any_value(n) // 2)) AS k FROM a GROUP BY station),
am AS (SELECT station, k, any_value(a.n) AS n, sqrt(pow(sum(v * cos(2 * pi() * k * t / a.n)), 2) + pow(sum(v * sin(2 * pi() * k * t / a.n)), 2)) AS amp FROM a JOIN fr USING (station) WHERE k::DOUBLE / a.n >= 1 / 720.0 GROUP BY station, k),
rk AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY round(amp, 9) DESC, k) AS rank, sum(amp * amp) OVER (PARTITION BY station) AS power FROM am)"""
WELCH = f"""{CENTRED}, sg AS (SELECT *, greatest(8, least(8760, n // 4)) AS m FROM a), st AS (SELECT station, any_value(m) AS m, unnest(generate_series(0, any_value(n) - any_value(m), any_value(m) - any_value(m) // 2)) AS s FROM sg GROUP BY station),
pt AS (SELECT st.station, st.s, st.m, t - s AS i, (v - avg(v) OVER (PARTITION BY st.station, st.s)) * (0.5 - 0.5 * cos(2 * pi() * (t - s) / st.m)) AS y FROM sg JOIN st ON st.station = sg.station AND t >= s AND t < s + st.m),
wn AS (SELECT station, any_value(m) AS m, sum(pow(0.5 - 0.5 * cos(2 * pi() * i / m), 2)) AS w FROM pt WHERE s = 0 GROUP BY station), ks AS (SELECT station, m, w, unnest(generate_series(1, m // 2)) AS k FROM wn),
pp AS (SELECT pt.station, k, s, any_value(ks.m) AS m, (pow(sum(y * cos(2 * pi() * k * i / ks.m)), 2) + pow(sum(y * sin(2 * pi() * k * i / ks.m)), 2)) / any_value(w) * CASE WHEN any_value(ks.m) % 2 = 0 AND k = any_value(ks.m) // 2 THEN 1 ELSE 2 END AS p FROM pt JOIN ks ON ks.station = pt.station GROUP BY pt.station, k, s),
dn AS (SELECT station, k, any_value(m) AS m, avg(p) AS psd FROM pp GROUP BY station, k), dr AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY round(psd, 9) DESC, k) AS rank FROM dn)"""


@query("pelt")
def pelt(spark, d):
    return k.breaks(index(spark, d), "roll")


QUANTILES = ((0.2, 1.0), (0.3, 2.0), (0.4, 1.5), (0.5, 1.0), (0.95, 0.5))
_VALUES = ", ".join(f"quantile_cont(dopy, {q})" for q, _ in QUANTILES)


@query("biweight", f"WITH RECURSIVE e AS (SELECT py, unnest([{_VALUES}]) AS onset, unnest([{', '.join(str(w) for _, w in QUANTILES)}]) AS weight FROM daily GROUP BY py), {biweight_sql('e', 'onset', 'weight')} SELECT py, round(ensemble, 6) + 0.0 AS ensemble, n FROM done", "daily")
def biweight(spark, d):
    m = s.daily(spark, d).groupBy("py").agg(*[F.percentile("dopy", q).alias(f"q{i}") for i, (q, _) in enumerate(QUANTILES)])
    rows = F.array(*[F.struct(F.col(f"q{i}").alias("onset"), F.lit(w).alias("weight")) for i, (_, w) in enumerate(QUANTILES)])
    return k.biweight(m.select("py", F.explode(rows).alias("r")).select("py", "r.*")).select("py", c.rounded("ensemble").alias("ensemble"), "n")


@query("hmm_filter", f"WITH RECURSIVE {INDEX}, {HIDDEN} SELECT slice AS py, date, CASE WHEN p0 >= 0.5 THEN 0::BIGINT ELSE 1 END AS state, round(greatest(p0, 1 - p0), 6) + 0.0 AS p FROM g WHERE own", "daily")
def hmm_filter(spark, d):
    return k.hidden_states(index(spark, d), ["idx"]).withColumn("p", c.rounded("p"))


@query("sr_kalman", f"WITH RECURSIVE {PLACE_TREND} SELECT t.place, date, CASE WHEN f.rn > 60 THEN round(level, 6) + 0.0 END AS level, CASE WHEN f.rn > 60 THEN round(trend, 6) + 0.0 END AS trend FROM f JOIN t ON t.place = f.place AND t.rn = f.rn", "places")
def sr_kalman(spark, d):
    """Level and trend of each place: a group is one place's daily series."""
    x = k.smoothed(s.places(spark, d), "cloud", key="place")
    return x.select("place", "date", c.rounded("level").alias("level"), c.rounded("trend").alias("trend"))


@query("arx_forecast")
def arx_forecast(spark, d):
    """The value six rows on for each place, from the last five rows of two fields: fits are aggregates by place."""
    return k.lagged_forecast(s.places(spark, d), "u_comp", "cloud", key="place")


# Least squares on a, b and their product: centred moments and Cramer's rule.
_PAIRS = ("aa", "ab", "ac", "bb", "bc", "cc", "ay", "by", "cy")
MOMENTS = "q AS (SELECT avg(v) AS a, avg(n) AS b, avg(v) * avg(n) AS c, avg(dopy) AS y FROM daily GROUP BY year(date), quarter(date)), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, covar_pop(y, y) AS yy, " + ", ".join(f"covar_pop({x[0]}, {x[1]}) AS {'yb' if x == 'by' else x}" for x in _PAIRS) + " FROM q)"
SOLVED = """d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
e AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / det AS ba, (aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / det AS b2, (aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / det AS b3 FROM d)"""


@query("ols_interaction", f"WITH {MOMENTS}, {SOLVED} SELECT round(ba, 4) + 0.0 AS beta_a, round(b2, 4) + 0.0 AS beta_b, round(b3, 4) + 0.0 AS beta_ab, round(my - ba * ma - b2 * mb - b3 * mc, 3) + 0.0 AS constant, round((ba * ay + b2 * yb + b3 * cy) / yy, 6) + 0.0 AS r2, n FROM e", "daily")
def ols_interaction(spark, d):
    y = s.daily(spark, d).groupBy(F.year("date").alias("y"), F.quarter("date").alias("q")).agg(F.avg("v").alias("a"), F.avg("n").alias("b"), F.avg("dopy").alias("onset"))
    fit = k.interaction_fit(y, "a", "b", "onset")
    return fit.select(*[c.rounded(x, 4).alias(x) for x in ("beta_a", "beta_b", "beta_ab")], c.rounded("constant", 3).alias("constant"), c.rounded("r2", 6).alias("r2"), "n")


@query("fft_peaks", f"WITH {FOURIER} SELECT station, rank, round(n / k::DOUBLE, 6) + 0.0 AS period, round(amp, 6) + 0.0 AS amplitude, round(100 * amp * amp / power, 6) + 0.0 AS power_pct FROM rk WHERE rank <= 10", "hourly")
def fft_peaks(spark, d):
    return k.spectrum(s.hourly(spark, d), "ws").select("station", "rank", *[c.rounded(x).alias(x) for x in ("period", "amplitude", "power_pct")])


@query("welch_psd", f"WITH {WELCH} SELECT station, rank, round(m / k::DOUBLE, 6) + 0.0 AS period, round(psd, 6) + 0.0 AS psd FROM dr WHERE rank <= 5", "hourly")
def welch_psd(spark, d):
    return k.density(s.hourly(spark, d), "ws").select("station", "rank", c.rounded("period").alias("period"), c.rounded("psd").alias("psd"))


#: Days of the nowcast's forecast.
AHEAD = 14


@query("nowcast", f"""WITH RECURSIVE {INDEX}, {HIDDEN}, {TREND}, hs AS (SELECT arg_max(p0, date) AS p0, max(date) AS date FROM g WHERE own AND date = (SELECT max(date) FROM g WHERE own)), ks AS (SELECT arg_max(level, rn) AS level, arg_max(trend, rn) AS trend FROM f)
SELECT date, CASE WHEN p0 >= 0.5 THEN 0::BIGINT ELSE 1 END AS state, round(greatest(p0, 1 - p0), 6) + 0.0 AS p, round(level, 6) + 0.0 AS level, round(trend, 6) + 0.0 AS trend, round(level + {AHEAD} * trend, 6) + 0.0 AS forecast FROM hs, ks""", "daily")
def nowcast(spark, d):
    """Latest state of the year by the causal filter, with the filtered level and trend and the level `ahead` days on by that trend, as one row."""
    x = index(spark, d)
    last = lambda df, *cols: df.agg(F.max(F.struct("date", *cols)).alias("m")).select("m.*")
    state = last(k.hidden_states(x, ["idx"]), "state", "p")
    level = last(k.smoothed(s.daily(spark, d).withColumn("station", F.lit(0)), "v"), "level", "trend").drop("date")
    return state.crossJoin(level).select("date", "state", c.rounded("p").alias("p"), c.rounded("level").alias("level"), c.rounded("trend").alias("trend"), c.rounded(F.col("level") + AHEAD * F.col("trend")).alias("forecast"))
