"""Views of the bundled tables as the observations that the operators expect, and the same views as SQL.

`obs`: raw samples from events. `hourly`: their means by hour and station. `daily`, `daily2`: daily series from orders
and lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import columns as c


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("time"), c.no_nan("value").alias("ws"), ((F.col("event_id") * 37) % 360).cast("double").alias("wd"), k.alias("cloud"),
        (F.col("value") * (1 + k / 100)).alias("gust"), F.when(F.col("event_type") == "purchase", F.col("value") / 100).otherwise(0.0).alias("precip"), (F.col("user_id") % 2).alias("station"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour, station and means; one row per station and hour that has samples."""
    return obs(spark, sf_dir).groupBy(F.date_trunc("hour", "time").alias("hour"), "station").agg(
        F.avg("ws").alias("ws"), c.circular_mean("wd").alias("wd"), F.avg("cloud").alias("cloud"), F.max("gust").alias("gust"), F.sum("precip").alias("precip")
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour and means over both stations."""
    return obs(spark, sf_dir).groupBy(F.date_trunc("hour", "time").alias("hour")).agg(
        F.avg("ws").alias("ws"), F.avg("cloud").alias("cloud"), F.max("gust").alias("gust"), F.sum("precip").alias("precip"), F.avg("wd").alias("wd")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, v (thousands) and n from orders, with the seasonal year and day."""
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1000).alias("v"), F.count("*").alias("n"))
    return d.withColumn("py", c.season_year("date")).withColumn("dopy", c.season_day_mod("date"))


def daily2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date and w (thousands) from lineitem."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((F.avg("l_extendedprice") / 1000).alias("w"))


#: Fields of `climate`: a mean, the swing over the seasonal year (largest on day 190) and the weights of two daily deviations.
FIELDS = {
    "u_comp": (0.10, 0.75, 0.15, 0.05), "u_mean": (0.15, 0.75, 0.12, 0.04), "u_std": (0.42, -0.16, 0.02, 0.01), "frac_west": (0.52, 0.46, 0.03, 0.02), "cloud": (72.0, 24.0, 1.0, 2.0),
    "cl_night": (75.0, 24.0, 2.0, 1.0), "tcwv": (44.0, 8.0, 1.0, 0.5), "sw_rad": (220.0, -60.0, 5.0, -8.0), "rh": (80.0, 10.0, 2.0, 1.0), "vpd": (1.0, -0.5, 0.05, 0.04), "dtr": (8.0, -2.0, 0.3, 0.2),
    "sm_7_28": (0.30, 0.08, 0.01, 0.005), "sm_28_100": (0.32, 0.06, 0.005, 0.01), "pressure": (1010.0, -2.0, 0.3, 0.2), "dew_pt": (22.0, 1.5, 0.2, 0.1), "precip": (6.0, 5.0, 0.5, 0.8), "du": (0.0, 1.2, 0.2, 0.1),
}


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily fields of one place: a seasonal swing and the deviations of `daily` and `daily2` from their means, null where the latter lacks a day."""
    x = daily(spark, sf_dir).join(daily2(spark, sf_dir), "date", "left")
    swing = F.cos(2 * 3.141592653589793 * (F.col("dopy") - 190) / 365)
    a, b = (F.col("v") - 150) / 15, (F.col("w") - 38) / 5
    return x.select("date", "py", "dopy", *[(m + s * swing + p * a + q * b).alias(n) for n, (m, s, p, q) in FIELDS.items()])


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily fields of several places (regions of the customers): the swing of `climate` and the deviation of the place's own orders."""
    region = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").cast("long").alias("place"))
    x = table(spark, sf_dir, "orders").join(region, "o_custkey").groupBy("place", F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1000).alias("v"))
    x = x.withColumn("dopy", c.season_day_mod("date"))
    swing = F.cos(2 * 3.141592653589793 * (F.col("dopy") - 190) / 365)
    return x.select("place", "date", "dopy", *[(m + s * swing + p * ((F.col("v") - 150) / 15)).alias(n) for n, (m, s, p, _) in FIELDS.items()])


def phase_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, phase (1 to 8, six days each) and amplitude of a phase index from lineitem."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.abs(F.avg("l_extendedprice") / 1000 - 38).alias("amplitude"))
    return x.select("date", (F.floor(F.unix_date("date") / 6) % 8 + 1).cast("int").alias("phase"), "amplitude")


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples over all years from orders: time, ws and wd, whose direction follows the month."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("time"), (F.col("o_totalprice") / 10000).alias("ws"), F.pmod(200 + 70 * F.sin(2 * F.pi() * F.month("o_orderdate") / 12) + (F.col("o_orderkey") * 37) % 80, F.lit(360.0)).alias("wd")
    )


PY = "(year(date) - CASE WHEN date < make_date(year(date), 6, 22) THEN 1 ELSE 0 END)"
CTE = {
    "obs": """obs AS (SELECT event_id, ts AS time, value AS ws, CAST((event_id * 37) % 360 AS DOUBLE) AS wd, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cloud,
  value * (1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100) AS gust, CASE WHEN event_type = 'purchase' THEN value / 100 ELSE 0 END AS precip, user_id % 2 AS station FROM events)""",
    "hourly": """hourly AS (SELECT date_trunc('hour', time) AS hour, station, avg(ws) AS ws, (degrees(atan2(avg(sin(radians(wd))), avg(cos(radians(wd))))) + 360) % 360 AS wd, avg(cloud) AS cloud, max(gust) AS gust, sum(precip) AS precip
  FROM obs GROUP BY ALL)""",
    "series": "series AS (SELECT date_trunc('hour', time) AS hour, avg(ws) AS ws, avg(cloud) AS cloud, max(gust) AS gust, sum(precip) AS precip, avg(wd) AS wd FROM obs GROUP BY ALL)",
    "daily": f"""daily AS (SELECT *, CAST({PY} AS BIGINT) AS py, CAST(date - make_date(CAST({PY} AS INT), 6, 22) AS BIGINT) % 365 AS dopy FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1000 AS v, count(*) AS n FROM orders GROUP BY ALL))""",
    "daily2": "daily2 AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) / 1000 AS w FROM lineitem GROUP BY ALL)",
}
CTE["years"] = "years AS (SELECT o_orderdate AS time, o_totalprice / 10000 AS ws, (200 + 70 * sin(2 * pi() * month(o_orderdate) / 12) + (o_orderkey * 37) % 80 + 360) % 360 AS wd FROM orders)"
_SWING = "cos(2 * 3.141592653589793 * (dopy - 190) / 365)"
CTE["climate"] = "climate AS (SELECT daily.date, py, dopy, " + ", ".join(f"{m}::DOUBLE + {a} * {_SWING} + {p} * ((v - 150) / 15) + {q} * ((w - 38) / 5) AS {n}" for n, (m, a, p, q) in FIELDS.items()) + " FROM daily LEFT JOIN daily2 USING (date))"
_OWN = ", ".join(f"{m}::DOUBLE + {a} * {_SWING} + {p} * ((v - 150) / 15) AS {n}" for n, (m, a, p, _) in FIELDS.items())
CTE["places"] = f"""places AS (SELECT place, date, dopy, {_OWN} FROM (SELECT *, CAST(date - make_date(CAST({PY} AS INT), 6, 22) AS BIGINT) % 365 AS dopy FROM (
  SELECT CAST(n_regionkey AS BIGINT) AS place, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1000 AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)))"""
CTE["phase_days"] = "phase_days AS (SELECT date, 1 + (date - DATE '1970-01-01') // 6 % 8 AS phase, amplitude FROM (SELECT CAST(l_shipdate AS DATE) AS date, abs(avg(l_extendedprice) / 1000 - 38) AS amplitude FROM lineitem GROUP BY ALL))"
NEEDS = {"hourly": ("obs",), "series": ("obs",), "climate": ("daily", "daily2")}


def with_views(sql: str, *names: str) -> str:
    """`sql` after the common table expressions of the named views."""
    wanted: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, ()), n):
            if x not in wanted:
                wanted.append(x)
    body = sql.strip()
    head = ", ".join(CTE[n] for n in wanted)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
