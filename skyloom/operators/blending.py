"""Two-station blending: weights, geometry, merges, corrections and inter-station statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import columns as c

#: Weights of the standard pair of stations: of variables that change quickly, and of soil variables. Fixed values.
VOLATILE, SOIL = (0.4154, 0.5846), (0.4996, 0.5004)


def split(df: DataFrame, fields: tuple[str, ...] = ("ws", "wd", "cloud")) -> tuple[DataFrame, DataFrame]:
    """The two stations side by side: hour and suffixed fields."""
    return tuple(df.where(F.col("station") == k).select("hour", *[F.col(f).alias(f"{f}_{k + 1}") for f in fields]) for k in (0, 1))


def scalar_blend(x: str, y: str, weights: tuple[float, float]) -> Column:
    """Weighted mean where both are there, else the one that is."""
    return F.coalesce(F.lit(weights[0]) * F.col(x) + F.lit(weights[1]) * F.col(y), F.col(x), F.col(y))


def direction_blend(x: str, y: str, weights: tuple[float, float], fallback: bool = True) -> Column:
    """Weighted mean of unit vectors; without `fallback` NULL where either is missing."""
    a, b = F.radians(F.col(x)), F.radians(F.col(y))
    both = F.pmod(F.degrees(F.atan2(weights[0] * F.sin(a) + weights[1] * F.sin(b), weights[0] * F.cos(a) + weights[1] * F.cos(b))), F.lit(360.0))
    return F.coalesce(both, F.col(x), F.col(y)) if fallback else both


def merged(df: DataFrame) -> DataFrame:
    """Full outer join of the stations by hour: speed and direction by the volatile weights, cloud by the soil weights."""
    a, b = split(df)
    return a.join(b, "hour", "full").select("hour", scalar_blend("ws_1", "ws_2", VOLATILE).alias("ws"), direction_blend("wd_1", "wd_2", VOLATILE).alias("wd"), scalar_blend("cloud_1", "cloud_2", SOIL).alias("cloud"))


def diagnostics(df: DataFrame, fields: list[str]) -> DataFrame:
    """Statistics of the difference of the stations for each field, where both have it."""
    long = df.select("hour", "station", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in fields])).alias("p")).select("hour", "station", "p.*")
    wide = long.groupBy("hour", "field").agg(F.max(F.when(F.col("station") == 0, F.col("x"))).alias("x"), F.max(F.when(F.col("station") == 1, F.col("x"))).alias("y")).where("x is not null and y is not null")
    d = F.col("x") - F.col("y")
    return wide.groupBy("field").agg(F.count("*").alias("n"), c.rounded(F.avg(d)).alias("bias"), c.rounded(F.stddev_samp(d)).alias("sd"), c.rounded(F.sqrt(F.avg(d * d))).alias("rmsd"), c.rounded(F.avg(F.abs(d))).alias("mae"), c.rounded(F.corr("x", "y")).alias("r"))


def inverse_distance_weights(d1: Column, d2: Column, power: float = 2.0) -> tuple[Column, Column]:
    """Normalised 1 / d**power; a coincident station gets everything."""
    a, b = F.pow(d1, F.lit(-power)), F.pow(d2, F.lit(-power))
    first = F.when(d1 < 1e-9, 1.0).when(d2 < 1e-9, 0.0).otherwise(a / (a + b))
    return first, 1 - first


def local_km(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Flat-earth offsets east and north in km."""
    return F.radians(lon - lon0) * 6371.0088 * F.cos(F.radians(lat0)), F.radians(lat - lat0) * 6371.0088


def baseline(points: DataFrame) -> DataFrame:
    """Share along the line from station 1 to 2 (clamped), distance across it and distances, for rows of three points."""
    p = {k: tuple(F.col(f"{k}_{x}") for x in ("lat", "lon")) for k in ("t", "s1", "s2")}
    bx, by = local_km(*p["s1"], *p["s2"])
    tx, ty = local_km(*p["s1"], *p["t"])
    length = bx * bx + by * by
    along = F.when(length < 1e-12, 0.5).otherwise(F.least(F.greatest((tx * bx + ty * by) / length, F.lit(0.0)), F.lit(1.0)))
    return points.withColumns({"along": along, "across": F.hypot(tx - along * bx, ty - along * by), "d1": c.haversine_km(*p["t"], *p["s1"]), "d2": c.haversine_km(*p["t"], *p["s2"]), "d12": c.haversine_km(*p["s1"], *p["s2"])})


def gradient_weights(geometry: DataFrame, decorrelation: str, power: str) -> DataFrame:
    """alpha = exp(-across / max(decorrelation / 4, 0.1)); weights alpha * linear + (1 - alpha) * inverse distance."""
    a, b = F.pow(F.col("d1"), -F.col(power)), F.pow(F.col("d2"), -F.col(power))
    alpha = F.exp(-F.col("across") / F.greatest(F.col(decorrelation) / 4, F.lit(0.1)))
    out = geometry.withColumns({"alpha": alpha, "idw1": a / (a + b)})
    w = F.col("alpha") * (1 - F.col("along")) + (1 - F.col("alpha")) * F.col("idw1")
    return out.withColumn("w1", w).withColumn("w2", 1 - F.col("w1"))


def lapse_corrected(x: str | Column, lapse_per_m: float, dz_m: float | Column) -> Column:
    return c.col(x) - F.lit(lapse_per_m) * (dz_m if isinstance(dz_m, Column) else F.lit(float(dz_m)))


def pressure_at(x: str | Column, dz_m: float, mean_temperature_k: Column | float = 298.0) -> Column:
    """Linear hypsometric correction."""
    t = mean_temperature_k if isinstance(mean_temperature_k, Column) else F.lit(float(mean_temperature_k))
    return c.col(x) * (1 - F.lit(9.80665 * dz_m) / (F.lit(287.05) * t))


def circular_sigma(r: str | Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(c.col(r), F.lit(-1.0)), F.lit(1.0))))


def winner(x: str, y: str, w1: float, w2: float) -> Column:
    """Categories do not mix: the heavier station wins."""
    return F.coalesce(F.col(x), F.col(y)) if w1 >= w2 else F.coalesce(F.col(y), F.col(x))
