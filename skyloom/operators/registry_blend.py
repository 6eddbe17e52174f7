"""Blending by a registry of variables: one plan for scalar, circular, categorical and pressure fields of many station pairs.

Observations are unpivoted to (pair, time, field, value of either station) and meet the registry, a table of some dozen rows.
Corrections, statistics, weights and the blend are columns of that one long table, so a new variable is a row of the
registry and not a branch of the plan. Statistics are one aggregate by pair and field; nothing is windowed.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators.blending import circular_sigma, local_km


@dataclass(frozen=True)
class Variable:
    """Kind, lapse per metre, quality of a terrain-fitted cell, power of distance weights, and decorrelation range in km."""

    field: str
    kind: str = "scalar"
    lapse: float = 0.0
    quality: float = 1.0
    power: float = 2.0
    range_km: float = 50.0


#: The variables, by canonical field. Fixed values.
REGISTRY = (
    Variable("temp2m", "scalar", 6.5e-3, 1.20, 2.0, 50.0),
    Variable("temp_app", "scalar", 6.5e-3, 1.15, 2.0, 50.0),
    Variable("dew_pt", "scalar", 0.5e-3, 1.15, 2.0, 40.0),
    Variable("st_0_7", "scalar", 5.0e-3, 1.25, 2.0, 20.0),
    Variable("st_7_28", "scalar", 4.0e-3, 1.20, 2.0, 20.0),
    Variable("st_28_100", "scalar", 3.0e-3, 1.15, 2.5, 30.0),
    Variable("st_100_255", "scalar", 2.0e-3, 1.10, 2.5, 40.0),
    Variable("rh", "scalar", 0.0, 1.15, 2.0, 40.0),
    Variable("vpd", "scalar", 0.0, 1.10, 2.0, 40.0),
    Variable("tcwv", "scalar", 0.0, 1.05, 2.0, 80.0),
    Variable("pressure", "pressure", 0.0, 1.05, 2.0, 100.0),
    Variable("precip", "scalar", 0.0, 0.95, 1.5, 15.0),
    Variable("rain", "scalar", 0.0, 0.95, 1.5, 15.0),
    Variable("ws10", "scalar", 0.0, 1.05, 1.5, 30.0),
    Variable("wd10", "circular", 0.0, 1.05, 1.5, 30.0),
    Variable("gust10", "scalar", 0.0, 1.05, 1.5, 25.0),
    Variable("ws100", "scalar", 0.0, 1.00, 1.5, 50.0),
    Variable("wd100", "circular", 0.0, 1.00, 1.5, 50.0),
    Variable("sw_rad", "scalar", 0.0, 1.00, 2.0, 100.0),
    Variable("sunshine", "scalar", 0.0, 1.00, 2.0, 50.0),
    Variable("cloud", "scalar", 0.0, 1.00, 1.5, 80.0),
    Variable("cloud_lo", "scalar", 0.0, 1.05, 1.5, 60.0),
    Variable("cloud_mid", "scalar", 0.0, 1.00, 1.5, 80.0),
    Variable("cloud_hi", "scalar", 0.0, 1.00, 1.5, 100.0),
    Variable("et0", "scalar", 0.0, 1.20, 2.0, 30.0),
    Variable("sm_0_7", "scalar", 0.0, 1.25, 2.0, 20.0),
    Variable("sm_7_28", "scalar", 0.0, 1.20, 2.0, 20.0),
    Variable("sm_28_100", "scalar", 0.0, 1.15, 2.5, 30.0),
    Variable("sm_100_255", "scalar", 0.0, 1.10, 2.5, 40.0),
    Variable("wcode", "categorical", 0.0, 1.00, 0.0, 20.0),
)
#: Km a metre of height counts for, gravity, gas constant of dry air, and the temperature that stands in for a missing one. Fixed values.
VERTICAL, GRAVITY, GAS, MEAN_K = 5e-3, 9.80665, 287.053, 298.0
#: Rows from which a power is estimated, its limits, and limits of the relative variance and distance. Fixed values.
LEAST_ROWS, POWERS, LEAST_DISTANCE, MOST = 48, (0.5, 3.0), 1e-3, 0.999


def registry(spark: SparkSession, variables: tuple[Variable, ...] = REGISTRY) -> DataFrame:
    return spark.createDataFrame([astuple(v) for v in variables], "field string, kind string, lapse double, quality double, power double, range_km double")


def spec_of(field: str, variables: tuple[Variable, ...] = REGISTRY) -> Variable:
    """The variable of that name, else the first of which one name begins with the other, else a plain scalar."""
    exact = next((v for v in variables if v.field == field), None)
    near = next((v for v in variables if field.startswith(v.field) or v.field.startswith(field)), None)
    found = exact or near or Variable(field)
    return Variable(field, *astuple(found)[1:])


def distance_3d(lat1: Column, lon1: Column, alt1: Column, lat2: Column, lon2: Column, alt2: Column) -> Column:
    """Great-circle distance and height, a metre of which counts as VERTICAL km."""
    return F.hypot(c.haversine_km(lat1, lon1, lat2, lon2), F.abs(alt1 - alt2) * VERTICAL)


def geometry(pairs: DataFrame) -> DataFrame:
    """pair, distances, the target's share along the line of the stations (clamped) and its distance from that line, heights and cells.

    `pairs`: pair and lat, lon, alt of s1, s2 and t, with s1_cell and s2_cell (`terrain` or another).
    """
    p = {k: tuple(F.col(f"{k}_{x}") for x in ("lat", "lon", "alt")) for k in ("s1", "s2", "t")}
    x1, y1 = local_km(p["t"][0], p["t"][1], p["s1"][0], p["s1"][1])
    x2, y2 = local_km(p["t"][0], p["t"][1], p["s2"][0], p["s2"][1])
    bx, by = x2 - x1, y2 - y1
    length = F.hypot(bx, by)
    along, across = -(x1 * bx + y1 * by) / length, F.abs(x1 * by - y1 * bx) / length
    return pairs.select(
        "pair", distance_3d(*p["s1"], *p["t"]).alias("d1"), distance_3d(*p["s2"], *p["t"]).alias("d2"), distance_3d(*p["s1"], *p["s2"]).alias("d12"),
        F.when(length < 1e-9, 0.5).otherwise(F.least(F.greatest(along, F.lit(0.0)), length) / length).alias("along"), F.when(length < 1e-9, 0.0).otherwise(across).alias("across"),
        (p["t"][2] - p["s1"][2]).alias("dz1"), (p["t"][2] - p["s2"][2]).alias("dz2"), "s1_cell", "s2_cell",
    )


def variogram_power(n: Column, var_d: Column, var_1: Column, var_2: Column, d12: Column, range_km: Column, default: Column) -> Column:
    """Half the exponent of a power variogram through the relative semivariance at the stations' distance, in limits; `default` for few rows or no variance."""
    gamma, sill = 0.5 * var_d, 0.5 * (var_1 + var_2)
    relative = F.least(gamma / sill, F.lit(MOST))
    distance = F.greatest(F.lit(LEAST_DISTANCE), F.least(d12 / F.greatest(range_km, F.lit(0.1)), F.lit(MOST)))
    power = F.least(F.greatest(F.log(relative) / F.log(distance) / 2, F.lit(POWERS[0])), F.lit(POWERS[1]))
    return F.when((n < LEAST_ROWS) | gamma.isNull() | sill.isNull() | (sill < 1e-12) | (gamma < 1e-12), default).otherwise(power)


def pair_values(rows: DataFrame, pairs: DataFrame, fields: tuple[str, ...], variables: tuple[Variable, ...] = REGISTRY) -> DataFrame:
    """pair, time, field, v1 and v2, corrected to the target's height, at the times that both stations have.

    `rows`: pair, station (1 or 2), time and fields. Pressure is corrected by the station's own mean temperature.
    """
    spark = rows.sparkSession
    long = rows.select("pair", "station", "time", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("p")).select("pair", "station", "time", "p.*")
    spec = registry(spark, tuple(spec_of(f, variables) for f in fields))
    means = rows.groupBy("pair", "station").agg((F.avg("temp2m") if "temp2m" in rows.columns else F.lit(None).cast("double")).alias("t")).select("pair", "station", F.coalesce(F.col("t") + 273.15, F.lit(MEAN_K)).alias("kelvin"))
    heights = geometry(pairs).select("pair", "dz1", "dz2")
    x = long.join(F.broadcast(spec), "field").join(means, ["pair", "station"]).join(heights, "pair").withColumn("dz", F.when(F.col("station") == 1, F.col("dz1")).otherwise(F.col("dz2")))
    flat = F.abs("dz") < 0.01
    shifted = F.when(flat, F.col("x")).when(F.col("kind") == "pressure", F.col("x") * (1.0 - GRAVITY * F.col("dz") / (GAS * F.col("kelvin")))).otherwise(F.col("x") - F.col("lapse") * F.col("dz"))
    of = lambda s: F.max(F.when(F.col("station") == s, shifted))
    both = x.groupBy("pair", "time", "field").agg(of(1).alias("v1"), of(2).alias("v2"), F.count_if(F.col("station") == 1).alias("_1"), F.count_if(F.col("station") == 2).alias("_2"))
    return both.where("_1 > 0 and _2 > 0").drop("_1", "_2")


def weights(values: DataFrame, pairs: DataFrame, fields: tuple[str, ...], variables: tuple[Variable, ...] = REGISTRY) -> DataFrame:
    """pair, field, n, kind, power (from the variogram of scalars), alpha, w1 and w2."""
    spec = registry(values.sparkSession, tuple(spec_of(f, variables) for f in fields))
    known = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    stats = values.where(known).groupBy("pair", "field").agg(F.count("*").alias("n"), F.var_samp(F.col("v1") - F.col("v2")).alias("var_d"), F.var_samp("v1").alias("var_1"), F.var_samp("v2").alias("var_2"))
    named = values.select("pair", "field").distinct().join(stats, ["pair", "field"], "left").withColumn("n", F.coalesce("n", F.lit(0))).join(F.broadcast(spec), "field").join(geometry(pairs), "pair")
    fitted = F.when(F.col("kind").isin("scalar", "pressure"), variogram_power(F.col("n"), F.col("var_d"), F.col("var_1"), F.col("var_2"), F.col("d12"), F.col("range_km"), F.col("power"))).otherwise(F.col("power"))
    quality = lambda s: F.when(F.col(f"{s}_cell") == "terrain", F.col("quality")).otherwise(1.0)
    x = named.withColumns({"p": fitted, "alpha": F.exp(-F.col("across") / F.greatest(F.col("range_km") / 4, F.lit(0.1)))})
    a, b = quality("s1") * F.pow("d1", -F.col("p")), quality("s2") * F.pow("d2", -F.col("p"))
    near = F.when((F.col("p") <= 0) | (F.col("d1") < 1e-9) | (F.col("d2") < 1e-9), 0.5).otherwise(a / (a + b))
    w1 = F.col("alpha") * (1 - F.col("along")) + (1 - F.col("alpha")) * near
    return x.select("pair", "field", "n", "kind", F.col("p").alias("power"), "alpha", w1.alias("w1"), (1 - w1).alias("w2"))


def blended(values: DataFrame, w: DataFrame) -> DataFrame:
    """pair, time, field, value and sigma: weighted means, mean directions, or the heavier station's category; null where either value is missing.

    Sigma is the stations' difference carried through the weights, the angular spread of directions, and null for categories.
    """
    x = values.join(w, ["pair", "field"])
    w1, w2, v1, v2 = (F.col(n) for n in ("w1", "w2", "v1", "v2"))
    known = v1.isNotNull() & v2.isNotNull()
    s, k = w1 * F.sin(F.radians(v1)) + w2 * F.sin(F.radians(v2)), w1 * F.cos(F.radians(v1)) + w2 * F.cos(F.radians(v2))
    value = F.when(F.col("kind") == "categorical", F.when(w1 >= w2, v1).otherwise(v2)).when(F.col("kind") == "circular", F.when(known, F.pmod(F.degrees(F.atan2(s, k)), F.lit(360.0)))).otherwise(w1 * v1 + w2 * v2)
    sigma = F.when(F.col("kind") == "circular", F.when(known, circular_sigma(F.hypot(s, k)))).when(F.col("kind") != "categorical", F.abs(v1 - v2) * F.sqrt(w1 * w1 + w2 * w2))
    return x.select("pair", "time", "field", value.alias("value"), sigma.alias("sigma"))


def agreement(values: DataFrame) -> DataFrame:
    """pair, field and the statistics of the difference of the stations: bias, spread, errors, r, consistency, and the swing of its mean day and mean year."""
    x = values.where(F.col("v1").isNotNull() & F.col("v2").isNotNull()).withColumn("d", F.col("v1") - F.col("v2"))
    d = F.col("d")
    whole = x.groupBy("pair", "field").agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.sqrt(F.avg(d * d)).alias("rmsd"), F.avg(F.abs(d)).alias("mae"), F.when(F.count("*") >= 10, c.correlation("v1", "v2")).alias("r"), (0.5 * (F.var_samp("v1") + F.var_samp("v2"))).alias("_v"))
    whole = whole.withColumn("consistency", F.when(F.coalesce("_v", F.lit(0.0)) < 1e-30, 1.0).otherwise(F.exp(-F.col("rmsd") * F.col("rmsd") / F.col("_v")))).drop("_v")

    def swing(part: Column, name: str) -> DataFrame:
        means = x.groupBy("pair", "field", part.alias("_k")).agg(F.avg(d).alias("m"))
        return means.groupBy("pair", "field").agg(F.when(F.count("*") > 1, F.max("m") - F.min("m")).otherwise(0.0).alias(name))

    return whole.join(swing(F.hour("time"), "diurnal_swing"), ["pair", "field"]).join(swing(F.month("time"), "monthly_swing"), ["pair", "field"])
