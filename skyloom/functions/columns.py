"""Column functions: circular statistics, the seasonal year, classes, rolling frames and fills.

Everything here maps Columns to Columns with built-in functions and aggregates, so it stays in generated code and works
in select, groupBy().agg and over windows alike. NaN is turned into NULL at ingest (`no_nan`) and never let in again.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: The seasonal year begins on 22 June.
ANCHOR_MONTH, ANCHOR_DAY = 6, 22
SECTORS_8 = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
SECTORS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Upper limits (km/h) of the Beaufort classes 0 to 11.
BEAUFORT = (1.0, 6.0, 12.0, 20.0, 29.0, 39.0, 50.0, 62.0, 75.0, 89.0, 103.0, 118.0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    """NaN becomes NULL; other values pass."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c), digits) + F.lit(0.0)


def where(condition: Column, c: str | Column) -> Column:
    return F.when(condition, col(c))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate; NaN if either column is constant, where `corr` fails by a division by zero."""
    scale = F.stddev_pop(col(x)) * F.stddev_pop(col(y))
    return F.when(scale == 0, float("nan")).otherwise(F.covar_pop(col(x), col(y)) / scale)


# circular statistics


def mean_sin(c: str | Column) -> Column:
    return F.avg(F.sin(F.radians(col(c))))


def mean_cos(c: str | Column) -> Column:
    return F.avg(F.cos(F.radians(col(c))))


def circular_mean(c: str | Column) -> Column:
    """Mean direction in degrees, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(mean_sin(c), mean_cos(c))), F.lit(360.0))


def resultant_length(c: str | Column) -> Column:
    return F.hypot(mean_sin(c), mean_cos(c))


def circular_std(c: str | Column) -> Column:
    r = F.least(resultant_length(c), F.lit(1.0))
    return F.when(r > 0, F.degrees(F.sqrt(-2 * F.log(r))))


def circular_difference(a: str | Column, b: str | Column) -> Column:
    """a - b wrapped to [-180, 180)."""
    return F.pmod(col(a) - col(b) + 180, F.lit(360.0)) - 180


def constancy(u: str | Column, v: str | Column) -> Column:
    """Length of the mean vector over the mean length; 0 where the mean length is 0."""
    scalar = F.avg(F.hypot(col(u), col(v)))
    return F.when(scalar > 0, F.hypot(F.avg(col(u)), F.avg(col(v))) / scalar).otherwise(F.when(scalar == 0, 0.0))


def wind_u(direction: str | Column, speed: str | Column | None = None) -> Column:
    return -F.sin(F.radians(col(direction))) * (F.lit(1.0) if speed is None else col(speed))


def wind_v(direction: str | Column, speed: str | Column | None = None) -> Column:
    return -F.cos(F.radians(col(direction))) * (F.lit(1.0) if speed is None else col(speed))


def direction_of(u: str | Column, v: str | Column) -> Column:
    """Direction that a wind vector comes from."""
    return F.pmod(F.degrees(F.atan2(-col(u), -col(v))), F.lit(360.0))


def sector(direction: str | Column, n: int) -> Column:
    """Number of the compass sector, from 0 (north)."""
    width = 360.0 / n
    return (F.floor(F.pmod(col(direction) + width / 2, F.lit(360.0)) / width) % n).cast("long")


def sector_name(direction: str | Column, n: int = 8) -> Column:
    names = SECTORS_8 if n == 8 else SECTORS_16
    return F.element_at(F.array(*[F.lit(x) for x in names]), (sector(direction, n) + 1).cast("int"))


def beaufort(speed_kmh: str | Column) -> Column:
    """First class whose limit is above the speed; 12 beyond the last."""
    found = F.lit(12)
    for k in range(11, -1, -1):
        found = F.when(col(speed_kmh) < BEAUFORT[k], k).otherwise(found)
    return F.when(col(speed_kmh).isNotNull(), found).cast("long")


def left_closed_bin(c: str | Column, edges: tuple[float, ...]) -> Column:
    """Number i of the bin edges[i - 1] <= x < edges[i]; 0 below the first edge, len(edges) from the last on."""
    found = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        found = F.when(col(c) < edges[k], k).otherwise(found)
    return F.when(col(c).isNotNull(), found).cast("long")


# the seasonal year


def season_year(date: str | Column) -> Column:
    """Year of the last anchor on or before the date."""
    d = F.to_date(col(date))
    return (F.year(d) - F.when(d < F.make_date(F.year(d), F.lit(ANCHOR_MONTH), F.lit(ANCHOR_DAY)), 1).otherwise(0)).cast("long")


def season_anchor(date: str | Column) -> Column:
    return F.make_date(season_year(date).cast("int"), F.lit(ANCHOR_MONTH), F.lit(ANCHOR_DAY))


def season_day(date: str | Column) -> Column:
    """Whole days since the anchor; 365 can occur."""
    return F.datediff(F.to_date(col(date)), season_anchor(date)).cast("long")


def season_day_mod(date: str | Column) -> Column:
    """Days since the anchor, modulo 365: the 366th day of a leap cycle is 0 again, so order by date, never by this."""
    return season_day(date) % 365


def season_fraction(time: str | Column) -> Column:
    """Days since the anchor with the hour as a fraction, modulo 365."""
    return F.pmod(season_day(time) + F.hour(col(time)) / 24.0, F.lit(365.0))


def season_date(year: str | Column, day: str | Column) -> Column:
    """Anchor of the year plus the day rounded half to even."""
    return F.date_add(F.make_date(col(year).cast("int"), F.lit(ANCHOR_MONTH), F.lit(ANCHOR_DAY)), F.bround(col(day), 0).cast("int"))


def leap(year: str | Column) -> Column:
    y = col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


# phases and labels

#: Operational phases of the wet cycle by seasonal day: half-open, the fifth wraps. Fixed values.
PHASES = ((1, 80.0, 130.0), (2, 130.0, 180.0), (3, 180.0, 250.0), (4, 250.0, 310.0))


def phase(day: str | Column) -> Column:
    d = F.pmod(col(day), F.lit(365.0))
    found = F.lit(5)
    for n, low, high in PHASES:
        found = F.when((d >= low) & (d < high), n).otherwise(found)
    return F.when(d.isNotNull(), found).otherwise(0).cast("long")


def two_sided_class(c: str | Column, limit: float, low: str, mid: str, high: str) -> Column:
    """Inclusive limits on either side; a missing value counts as the middle class."""
    return F.when(col(c) >= limit, high).when(col(c) <= -limit, low).otherwise(mid)


def enso_class(c: str | Column) -> Column:
    return two_sided_class(c, 0.50, "LANINA", "NETRAL", "ELNINO")


def iod_class(c: str | Column) -> Column:
    return two_sided_class(c, 0.40, "nIOD", "NETRAL", "pIOD")


def interaction(enso: str | Column, iod: str | Column) -> Column:
    e, i = col(enso), col(iod)
    same = ((e == "ELNINO") & (i == "pIOD")) | ((e == "LANINA") & (i == "nIOD"))
    against = ((e == "ELNINO") & (i == "nIOD")) | ((e == "LANINA") & (i == "pIOD"))
    return F.when(same, "SINERGI").when(against, "COUNTER").otherwise("NETRAL")


# frames, rolls and fills (row-based: missing days are not inserted)


def centered(w: WindowSpec, n: int) -> WindowSpec:
    """Frame of n rows around the current one; an even n reaches one row further back."""
    return w.rowsBetween(-(n - 1 - (n - 1) // 2), (n - 1) // 2)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(agg, c: str | Column, frame: WindowSpec, least: int) -> Column:
    """`agg` over the frame where it holds at least `least` values."""
    return F.when(F.count(col(c)).over(frame) >= least, agg(col(c)).over(frame))


def forward_fill(c: str | Column, w: WindowSpec) -> Column:
    return F.last(col(c), ignorenulls=True).over(w.rowsBetween(-(1 << 31) + 1, 0))


def back_fill(c: str | Column, w: WindowSpec) -> Column:
    return F.first(col(c), ignorenulls=True).over(w.rowsBetween(0, (1 << 31) - 1))


def zscore(c: str | Column, w: WindowSpec, floor: float = 1e-9) -> Column:
    """(x - mean) / sample deviation over the window; NULL where the deviation is below `floor`."""
    sd = F.stddev_samp(col(c)).over(w)
    return F.when(sd >= floor, (col(c) - F.avg(col(c)).over(w)) / sd)


# distance


def haversine_km(lat1, lon1, lat2, lon2, radius: float = 6371.0088) -> Column:
    """Great-circle distance; arguments are Columns or numbers in degrees."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))
