"""Queries of the station loads: rows of two stations in two resolutions, derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators import registry_blend as rb
from skyloom.plans.observations import r6
from skyloom.plans.registry import query
from skyloom.sources import stations
from skyloom.sources import surrogate as s

#: Canonical fields of a row and what they are in the hourly view.
BOUND = {"temp2m": "gust", "cloud": "cloud", "vpd": "cloud / 100", "sm_0_7": "ws / 1000", "sunshine": "precip * 60", "sw_rad": "ws", "ws10": "ws", "gust10": "gust", "precip": "precip", "wd10": "wd"}


def rows(spark: SparkSession, d: str) -> DataFrame:
    """P1 hourly and six-hourly, P2 six-hourly only, in the columns of the station source."""
    hourly = s.hourly(spark, d)
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("hour").cast("timestamp")) / 21600) * 21600).cast("timestamp_ntz")
    six = hourly.groupBy(slot.alias("hour"), "station").agg(F.avg("ws").alias("ws"), c.circular_mean("wd").alias("wd"), F.avg("cloud").alias("cloud"), F.max("gust").alias("gust"), F.sum("precip").alias("precip"))
    fine = hourly.where("station = 0").select(F.lit(stations.HOUR).alias("step"), F.lit(0).alias("rank"), *six.columns)
    both = fine.unionByName(six.select(F.lit(stations.SIX_HOURS).alias("step"), (1 + F.col("station")).cast("int").alias("rank"), *six.columns))
    named = both.select(F.concat(F.lit("P"), F.col("station") + 1).alias("station"), "step", "rank", F.col("hour").alias("time"), *[F.expr(x).alias(n) for n, x in BOUND.items()])
    return named.select("station", "step", "rank", "time", *[F.col(f) if f in BOUND else F.lit(None).cast("double").alias(f) for f in stations.FIELDS])


ROWS = """six AS (SELECT time_bucket(INTERVAL 6 HOUR, hour) AS hour, station, avg(ws) AS ws, (degrees(atan2(avg(sin(radians(wd))), avg(cos(radians(wd))))) + 360) % 360 AS wd, avg(cloud) AS cloud, max(gust) AS gust, sum(precip) AS precip FROM hourly GROUP BY 1, 2),
rows AS (SELECT 3600 AS step, 0 AS rank, hour, station, ws, wd, cloud, gust, precip FROM hourly WHERE station = 0 UNION ALL SELECT 21600, 1 + station, hour, station, ws, wd, cloud, gust, precip FROM six),
finest AS (SELECT station, min(step) AS step FROM rows GROUP BY 1), kept AS (SELECT r.* FROM rows r JOIN finest f ON f.station = r.station AND f.step = r.step)"""


def pair(x: str, a: float, b: float) -> str:
    return f"coalesce({a} * max(CASE WHEN station = 0 THEN {x} END) + {b} * max(CASE WHEN station = 1 THEN {x} END), max(CASE WHEN station = 0 THEN {x} END), max(CASE WHEN station = 1 THEN {x} END))"


QUICK, SOIL = (0.4154, 0.5846), (0.4996, 0.5004)


@query("station_daily_load", f"""WITH {ROWS}, days AS (SELECT station, CAST(hour AS DATE) AS date, max(gust) - min(gust) AS dtr, avg(cloud) AS cloud_mean,
  avg(CASE WHEN (step = 3600 AND hour(hour) BETWEEN 12 AND 17) OR (step = 21600 AND hour(hour) IN (12, 18)) THEN cloud END) AS cloud_aft, avg(ws / 1000) AS sm_sh, sum(precip * 60) / 3600 AS sunshine_h, sum(ws) * max(step) / 1e6 AS sw, avg(cloud / 100) AS vpd FROM kept GROUP BY 1, 2)
SELECT date, round({pair('dtr', *QUICK)}, 9) AS dtr, round({pair('cloud_mean', *QUICK)}, 9) AS cloud_mean, round({pair('cloud_aft', *QUICK)}, 9) AS cloud_aft, round({pair('sm_sh', *SOIL)}, 9) AS sm_sh, round({pair('sunshine_h', *QUICK)}, 9) AS sunshine_h, round({pair('sw', *QUICK)}, 9) AS sw_rad_mj, round({pair('vpd', *QUICK)}, 9) AS vpd
FROM days GROUP BY 1""", "hourly")
def station_daily_load(spark, d):
    """Aggregated for each station in its finest resolution first, merged by class of field then."""
    out = stations.daily_load(rows(spark, d))
    return out.select("date", *[F.round(n, 9).alias(n.lower()) for n in ("dtr", "cloud_mean", "cloud_aft", "sm_sh", "sunshine_h", "sw_rad_MJ", "vpd")])


@query("station_hourly_load", f"""WITH {ROWS}, x AS (SELECT hour AS time, {pair('ws', *QUICK)} AS ws, {pair('precip', *QUICK)} AS precip,
  (degrees(atan2(sum(CASE station WHEN 0 THEN 0.4154 ELSE 0.5846 END * sin(radians(wd))), sum(CASE station WHEN 0 THEN 0.4154 ELSE 0.5846 END * cos(radians(wd))))) + 360) % 360 AS wd FROM kept GROUP BY 1)
SELECT time, round(ws, 9) AS ws, round(precip, 9) AS precip, {r6('wd')} AS wd, CAST(hour(time) AS BIGINT) AS hour, CAST(month(time) AS BIGINT) AS month, {r6('-sin(radians(wd))')} AS u, {r6('-cos(radians(wd))')} AS v FROM x""", "hourly")
def station_hourly_load(spark, d):
    """Scan, choice of source, merge of scalars and directions, and time features in one plan."""
    out = stations.hourly_load(rows(spark, d), fields=("ws10", "gust10", "precip", "cloud"))
    return out.select("time", F.round("ws10", 9).alias("ws"), F.round("precip", 9).alias("precip"), c.rounded("wd10").alias("wd"), "hour", "month", c.rounded("u").alias("u"), c.rounded("v").alias("v"))


#: The standard stations and target: latitude, longitude, height, and the cells' kind. Fixed values.
POINTS = {"s1": (-7.486819, 112.538210, 12.0), "s2": (-7.5571175, 112.557350, 13.0), "t": (-7.521951, 112.566089, 10.0)}
BLENDED = ("temp2m", "pressure", "ws10", "wd10", "cloud", "wcode", "precip")


def station_pairs(spark):
    names = [f"{p}_{x}" for p in POINTS for x in ("lat", "lon", "alt")]
    return spark.createDataFrame([(0, *[v for p in POINTS.values() for v in p], "terrain", "nearest")], "pair int, " + ", ".join(f"{n} double" for n in names) + ", s1_cell string, s2_cell string")


def two_stations(spark, d):
    """The two stations' hourly rows in canonical fields."""
    return s.hourly(spark, d).select(F.lit(0).alias("pair"), (F.col("station") + 1).alias("station"), F.col("hour").alias("time"), (F.col("gust") / 4).alias("temp2m"), (900 + F.col("cloud")).alias("pressure"), F.col("ws").alias("ws10"), F.col("wd").alias("wd10"), "cloud", F.floor(F.col("cloud") / 20).alias("wcode"), "precip")


def _geometry_sql() -> str:
    (a1, o1, h1), (a2, o2, h2), (at, ot, ht) = POINTS.values()
    hav = lambda p, q: f"2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin(radians({q[0]} - ({p[0]})) / 2), 2) + cos(radians({p[0]})) * cos(radians({q[0]})) * pow(sin(radians({q[1]} - ({p[1]})) / 2), 2), 0), 1)))"
    far = lambda p, q: f"sqrt(pow({hav(p, q)}, 2) + pow(abs({p[2]} - ({q[2]})) * 0.005, 2))"
    s1, s2, t = POINTS.values()
    flat = f"radians({o1} - ({ot})) * 6371.0088 * cos(radians({at})) AS x1, radians({a1} - ({at})) * 6371.0088 AS y1, radians({o2} - ({ot})) * 6371.0088 * cos(radians({at})) AS x2, radians({a2} - ({at})) * 6371.0088 AS y2"
    return f"""g0 AS (SELECT {far(s1, t)} AS d1, {far(s2, t)} AS d2, {far(s1, s2)} AS d12, {flat}), g AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM g0),
geo AS (SELECT d1, d2, d12, least(greatest(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / len, 0), len) / len AS along, abs(x1 * (y2 - y1) - y1 * (x2 - x1)) / len AS across FROM g)"""


_SPEC = ", ".join(f"('{f}', '{v.kind}', {v.lapse}::DOUBLE, {v.quality}::DOUBLE, {v.power}::DOUBLE, {v.range_km}::DOUBLE)" for f in BLENDED for v in [rb.spec_of(f)])
_DZ = f"CASE station WHEN 0 THEN {POINTS['t'][2] - POINTS['s1'][2]}::DOUBLE ELSE {POINTS['t'][2] - POINTS['s2'][2]}::DOUBLE END"
BLEND = f"""spec AS (SELECT * FROM (VALUES {_SPEC}) v(field, kind, lapse, quality, power, range_km)), {_geometry_sql()},
o AS (SELECT hour, station, unnest(['temp2m', 'pressure', 'ws10', 'wd10', 'cloud', 'wcode', 'precip']) AS field, unnest([gust / 4, 900 + cloud, ws, wd, cloud, floor(cloud / 20), precip]) AS x FROM hourly),
k AS (SELECT station, avg(gust / 4) + 273.15 AS kelvin FROM hourly GROUP BY 1),
z AS (SELECT hour, station, field, CASE WHEN kind = 'pressure' THEN x * (1.0::DOUBLE - 9.80665 * ({_DZ}) / (287.053 * kelvin)) ELSE x - lapse * ({_DZ}) END AS x FROM o JOIN spec USING (field) JOIN k USING (station)),
v AS (SELECT a.hour, a.field, a.x AS v1, b.x AS v2 FROM z a JOIN z b ON a.hour = b.hour AND a.field = b.field AND a.station = 0 AND b.station = 1),
st AS (SELECT field, count(*) AS n, 0.5 * var_samp(v1 - v2) AS gamma, 0.5 * (var_samp(v1) + var_samp(v2)) AS sill FROM v WHERE v1 IS NOT NULL AND v2 IS NOT NULL GROUP BY 1),
pw AS (SELECT spec.*, coalesce(n, 0) AS n, geo.*, CASE WHEN kind IN ('scalar', 'pressure') AND n >= 48 AND sill >= 1e-12 AND gamma >= 1e-12 THEN least(greatest(ln(least(gamma / sill, 0.999)) / ln(greatest(0.001, least(d12 / greatest(range_km, 0.1), 0.999))) / 2, 0.5), 3.0) ELSE power END AS p FROM spec LEFT JOIN st USING (field), geo),
wt AS (SELECT field, kind, n, p, exp(-across / greatest(range_km / 4, 0.1)) AS alpha, along, CASE WHEN p <= 0 THEN 0.5 ELSE quality * pow(d1, -p) / (quality * pow(d1, -p) + pow(d2, -p)) END AS near FROM pw),
w AS (SELECT *, alpha * (1 - along) + (1 - alpha) * near AS w1, 1 - (alpha * (1 - along) + (1 - alpha) * near) AS w2 FROM wt)"""


@query("variogram_weights", f"WITH {BLEND} SELECT field, CAST(n AS BIGINT) AS n, round(p, 9) AS power, round(alpha, 9) AS alpha, round(w1, 9) AS w1, round(w2, 9) AS w2 FROM w", "hourly")
def variogram_weights(spark, d):
    """Power by variogram, reliability of the gradient, and weights of each variable of the registry."""
    w = rb.weights(rb.pair_values(two_stations(spark, d), station_pairs(spark), BLENDED), station_pairs(spark), BLENDED)
    return w.select("field", "n", *[F.round(x, 9).alias(x) for x in ("power", "alpha", "w1", "w2")])


@query("registry_blend", f"""WITH {BLEND} SELECT hour AS time, field, round(CASE WHEN kind = 'categorical' THEN CASE WHEN w1 >= w2 THEN v1 ELSE v2 END WHEN kind = 'circular' THEN (degrees(atan2(w1 * sin(radians(v1)) + w2 * sin(radians(v2)), w1 * cos(radians(v1)) + w2 * cos(radians(v2)))) + 360) % 360 ELSE w1 * v1 + w2 * v2 END, 7) + 0.0 AS value,
  CASE WHEN kind = 'circular' THEN round(degrees(acos(least(sqrt(pow(w1 * cos(radians(v1)) + w2 * cos(radians(v2)), 2) + pow(w1 * sin(radians(v1)) + w2 * sin(radians(v2)), 2)), 1.0))), 4) + 0.0 WHEN kind <> 'categorical' THEN round(abs(v1 - v2) * sqrt(w1 * w1 + w2 * w2), 4) + 0.0 END AS sigma FROM v JOIN w USING (field)""", "hourly")
def registry_blend(spark, d):
    """Scalar, pressure, circular and categorical variables of two stations blended in one plan, with their spread."""
    values = rb.pair_values(two_stations(spark, d), station_pairs(spark), BLENDED)
    out = rb.blended(values, rb.weights(values, station_pairs(spark), BLENDED))
    return out.select("time", "field", c.rounded("value", 7).alias("value"), c.rounded("sigma", 4).alias("sigma"))


@query("station_agreement", f"""WITH {BLEND}, x AS (SELECT *, v1 - v2 AS d FROM v WHERE v1 IS NOT NULL AND v2 IS NOT NULL), t AS (SELECT field, count(*) AS n, avg(d) AS bias, stddev_samp(d) AS sd, sqrt(avg(d * d)) AS rmsd, avg(abs(d)) AS mae, corr(v1, v2) AS r, 0.5 * (var_samp(v1) + var_samp(v2)) AS jv FROM x GROUP BY 1),
h AS (SELECT field, max(m) - min(m) AS dw FROM (SELECT field, hour(hour), avg(d) AS m FROM x GROUP BY 1, 2) GROUP BY 1), mo AS (SELECT field, max(m) - min(m) AS mw FROM (SELECT field, month(hour), avg(d) AS m FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT field, n, {r6('bias')} AS bias, {r6('sd')} AS sd, {r6('rmsd')} AS rmsd, {r6('mae')} AS mae, {r6('CASE WHEN n >= 10 THEN r END')} AS r, {r6('CASE WHEN jv < 1e-30 THEN 1.0 ELSE exp(-rmsd * rmsd / jv) END')} AS consistency, {r6('dw')} AS diurnal_swing, {r6('mw')} AS monthly_swing FROM t JOIN h USING (field) JOIN mo USING (field)""", "hourly")
def station_agreement(spark, d):
    """How two stations differ in each variable: bias, errors, consistency, and the swing of the difference over day and year."""
    x = rb.agreement(rb.pair_values(two_stations(spark, d), station_pairs(spark), BLENDED))
    return x.select("field", "n", *[c.rounded(k).alias(k) for k in ("bias", "sd", "rmsd", "mae", "r", "consistency", "diurnal_swing", "monthly_swing")])
