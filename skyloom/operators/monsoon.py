"""Onset and offset detectors of the rainy monsoon, declared as rules over daily fields and run on all seasonal years at once.

A detector is a signal and a level that it must reach and hold. Its signal is either one rolled field, or the share of days
(the mean score) on which rules over rolled fields hold. A rule compares a rolled field with a fixed limit or with a percentile of
the field's own dry season. Everything is a window by seasonal year over daily rows: the aggregation to days comes before,
so a window holds 365 rows. The input has py, date, dopy and the fields that a detector names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators import detectors as det

# Windows of the seasonal day, weights and limits that right results depend on.
DRY, DRY_WIND, WET = (50, 130), (60, 120), (140, 220)
ONSET, OFFSET, SEARCH = (100, 195), (190, 330), (60, 200)
ADVECTION_ONSET, ADVECTION_OFFSET = (150, 260), (220, 320)
#: Field, sign and weight of the persistence index; the weights sum to 14.
INDEX_FIELDS = (("tcwv", 1, 2.5), ("cloud", 1, 2.5), ("u_comp", 1, 2.0), ("sw_rad", -1, 2.0), ("rh", 1, 1.5), ("vpd", -1, 1.5), ("dtr", -1, 1.0), ("sm_7_28", 1, 1.0))
#: Field and sign of the precursor index.
PRECURSOR_FIELDS = (("u_comp", 1), ("rh", 1), ("dew_pt", 1), ("tcwv", 1), ("cloud", 1), ("precip", 1), ("vpd", -1))


@dataclass(frozen=True)
class Percentile:
    """A percentile of the rolled field within `days` of the year, of the whole year where fewer than `least` values stand there."""

    q: float
    days: tuple[int, int] = DRY
    least: int = 5
    factor: float = 1.0


@dataclass(frozen=True)
class Rule:
    """`field`, rolled over `n` centred days, lies above (or below) `limit`; a crossing must hold for `hold` rows, so many of them known."""

    field: str
    n: int
    above: bool
    limit: float | Percentile
    hold: tuple[int, int] = (10, 7)


@dataclass(frozen=True)
class Detector:
    """The first day in `days` on which the signal is at `level` and `least` of the next `sustain` days hold it.

    With one rule and no `trail` the signal is the rolled field and the level the rule's limit. Else it is the mean over `trail`
    (rows, values needed) of the rules that hold: all of them ("all"), any ("any") or how many ("score").
    """

    name: str
    rules: tuple[Rule, ...]
    days: tuple[int, int]
    sustain: int = 14
    least: int = 9
    combine: str = "all"
    trail: tuple[int, int] | None = None
    level: float = 0.0
    #: Further fields, rolled over seven days, that must be known for a day to count.
    known: tuple[str, ...] = ()


def above(field: str, n: int, limit: float | Percentile) -> Rule:
    return Rule(field, n, True, limit)


def below(field: str, n: int, limit: float | Percentile) -> Rule:
    return Rule(field, n, False, limit)


#: Cloud, wind, radiation, soil, dryness and pressure: first days and last days of the wet season.
SEASON_DETECTORS = (
    Detector("B2_on", (above("u_comp", 7, -0.30), above("cloud", 7, 76.0), above("tcwv", 7, 45.0)), ONSET, 10, 7, "all", (14, 9), 0.65),
    Detector("B2_off", (below("u_comp", 7, -0.5), below("cloud", 7, 55.0)), OFFSET, 10, 7, "any", (14, 9), 0.70),
    Detector("B3_on", (below("sw_rad", 21, Percentile(15)),), ONSET),
    Detector("B3_off", (above("sw_rad", 21, Percentile(15)),), OFFSET),
    Detector("B4_on", (above("sm_7_28", 21, Percentile(20, WET, 31)), above("sm_28_100", 21, Percentile(20, WET, 31))), ONSET, 10, 7, "all", (14, 9), 0.70),
    Detector("B4_off", (below("sm_7_28", 21, Percentile(65)),), OFFSET),
    Detector("B5_on", (below("vpd", 21, Percentile(15)), above("rh", 21, Percentile(88))), ONSET, 10, 7, "all", (14, 9), 0.65),
    Detector("B5_off", (above("vpd", 21, Percentile(35)),), OFFSET),
    Detector("B6_on", (below("pressure", 14, Percentile(20)),), ONSET),
    Detector("B6_off", (above("pressure", 14, Percentile(40)),), OFFSET),
)
#: Westerly advection by score, by wind alone and by cloudy nights, and its end.
ADVECTION_DETECTORS = (
    Detector("A1_on", (above("u_mean", 7, 0.65), below("u_std", 7, 0.35), above("frac_west", 7, 0.85), above("cl_night", 7, 90.0), above("cloud", 7, 90.0)), ADVECTION_ONSET, 10, 6, "score", (14, 10), 4.0),
    Detector("A2_on", (above("u_mean", 7, 0.70), above("frac_west", 7, 0.90)), ADVECTION_ONSET, 21, 14, "all", (21, 14), 0.75),
    Detector("A3_on", (above("cl_night", 7, 95.0), above("cloud", 7, 92.0), above("u_mean", 7, 0.30)), ADVECTION_ONSET, 14, 10, "all", (14, 10), 0.70),
    Detector("A1_off", (below("u_mean", 7, 0.30), below("cl_night", 7, 85.0)), ADVECTION_OFFSET, 10, 6, "any", (14, 10), 0.55, ("u_std",)),
)
#: Crossings of a 30-day mean: dryness, dew point, vertical shear, soil and the wind itself.
CROSSING_DETECTORS = (
    Rule("vpd", 30, False, Percentile(50, DRY_WIND, 10, 0.65)), Rule("dew_pt", 30, True, Percentile(97, DRY_WIND, 10)), Rule("du", 30, True, 0.0),
    Rule("sm_7_28", 30, True, Percentile(80, DRY_WIND, 10)), Rule("u_comp", 30, True, 0.0, (15, 10)),
)
CROSSING_NAMES = ("M6_vpd", "M7_dew_point", "M8_shear", "M9_soil", "M10_wind")


def of_year(df: DataFrame) -> DataFrame:
    """The first 365 days of each seasonal year."""
    return df.where(c.season_day("date") < 365)


#: Days that a year must have for the advection and reversal methods: 180 days and 5,000 hours. Fixed values.
ADVECTION_DAYS, REVERSAL_DAYS = 180, 209


def complete(df: DataFrame, least_days: int) -> DataFrame:
    """The rows of years that have at least `least_days` days; no others get an onset."""
    return of_year(df).withColumn("_days", F.count(F.lit(1)).over(det.year())).where(F.col("_days") >= least_days).drop("_days")


def rolled(field: str, n: int) -> Column:
    return c.rolling(F.avg, field, c.centered(det.in_year(), n), n // 2)


def limit_of(x: str, limit: float | Percentile, strict: bool = False) -> Column:
    """A rule's limit for the rolled column `x`, one value a year; null for too few values if `strict`."""
    if not isinstance(limit, Percentile):
        return F.lit(float(limit))
    own = F.when(F.col("dopy").between(*limit.days), F.col(x))
    every = F.lit(None).cast("double") if strict else F.percentile(x, limit.q / 100).over(det.year())
    return F.when(F.count(own).over(det.year()) >= limit.least, F.percentile(own, limit.q / 100).over(det.year())).otherwise(every) * limit.factor


def signal(df: DataFrame, d: Detector) -> DataFrame:
    """`df` with `_signal` and `_level` of a detector, and `_up`, whether the signal must be above the level."""
    x = of_year(df).withColumns({f"_r{i}": rolled(r.field, r.n) for i, r in enumerate(d.rules)})
    x = x.withColumns({f"_l{i}": limit_of(f"_r{i}", r.limit) for i, r in enumerate(d.rules)})
    if d.trail is None:
        return x.withColumns({"_signal": F.col("_r0"), "_level": F.col("_l0")})
    holds = [(F.col(f"_r{i}") > F.col(f"_l{i}") if r.above else F.col(f"_r{i}") < F.col(f"_l{i}")) for i, r in enumerate(d.rules)]
    x = x.withColumns({f"_k{i}": rolled(f, 7) for i, f in enumerate(d.known)})
    known = F.lit(True)
    for name in [f"_r{i}" for i in range(len(d.rules))] + [f"_k{i}" for i in range(len(d.known))]:
        known = known & F.col(name).isNotNull()
    number = sum((h.cast("double") for h in holds), F.lit(0.0))
    joint = {"all": (number == len(holds)).cast("double"), "any": (number > 0).cast("double"), "score": number}[d.combine]
    n, least = d.trail
    x = x.withColumn("_joint", F.when(known, joint))
    return x.withColumns({"_signal": c.rolling(F.avg, "_joint", c.trailing(det.in_year(), n), least), "_level": F.lit(d.level)})


def detected(df: DataFrame, d: Detector, eps: float = 0.025) -> DataFrame:
    """(py, onset) of a detector."""
    up = True if d.trail else d.rules[0].above
    return det.persistent(signal(df, d), "_signal", F.col("_level"), *d.days, d.sustain, d.least, up, eps)


def crossed(df: DataFrame, rule: Rule, eps: float = 0.005) -> DataFrame:
    """(py, onset): first crossing of the limit by the rolled field that holds for the rule's rows."""
    x = of_year(df).withColumn("_r0", rolled(rule.field, rule.n))
    return det.crossing(x.withColumn("_l0", limit_of("_r0", rule.limit, True)), "_r0", F.col("_l0"), *SEARCH, *rule.hold, rule.above, eps)


def carried(field: str) -> Column:
    """The last known value of the whole series, and before the first one that."""
    order = Window.partitionBy(F.lit(1)).orderBy("date")
    last = F.last(field, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(last, F.first(field, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))


def weighted_index(daily: DataFrame, fields=INDEX_FIELDS, share: float = 0.4, least: int = 4, values: int = 100) -> DataFrame:
    """`daily` with `idx`: the weighted mean of the standardised fields, rescaled to the weights at hand.

    A field takes part with more than `values` values; null with fewer than `least` fields or less than `share` of the weights.
    """
    total = sum(w for *_, w in fields)
    whole = Window.partitionBy(F.lit(1))
    x = daily.withColumns({f"_f{i}": carried(f) for i, (f, _, _) in enumerate(fields)})
    x = x.withColumns({f"_n{i}": F.count(f).over(whole) for i, (f, _, _) in enumerate(fields)} | {f"_d{i}": F.stddev_samp(f"_f{i}").over(whole) for i in range(len(fields))})
    enough = [(F.col(f"_n{i}") > values) for i in range(len(fields))]
    takes = [e & (F.coalesce(F.col(f"_d{i}"), F.lit(0.0)) >= 1e-9) for i, e in enumerate(enough)]
    used = sum((F.when(t, w).otherwise(0.0) for t, (*_, w) in zip(takes, fields, strict=True)), F.lit(0.0))
    z = [F.when(t, s * w * (F.col(f"_f{i}") - F.avg(f"_f{i}").over(whole)) / F.col(f"_d{i}")).otherwise(0.0) for i, (t, (_, s, w)) in enumerate(zip(takes, fields, strict=True))]
    known = sum((e.cast("int") for e in enough), F.lit(0))
    names = [n for n in x.columns if n.startswith(("_f", "_n", "_d")) and n[2:].isdigit()]
    return x.withColumn("idx", F.when((known >= least) & (used >= share * total), sum(z, F.lit(0.0)) / used)).drop(*names)


def persistence_index(daily: DataFrame) -> DataFrame:
    """`idx`, its centred 21-day mean `roll` and its trailing one `causal`, over the whole series."""
    order = Window.partitionBy(F.lit(1)).orderBy("date")
    x = weighted_index(daily)
    return x.withColumns({"roll": c.rolling(F.avg, "idx", c.centered(order, 21), 10), "causal": c.rolling(F.avg, "idx", c.trailing(order, 21), 10)})


def precursor_index(daily: DataFrame) -> DataFrame:
    """Mean of the standardised precursors within each year (at least three), gaps carried on, and its centred 30-day mean `roll`."""
    x, used = of_year(daily), F.lit(0)
    total = F.lit(0.0)
    for i, (field, sign) in enumerate(PRECURSOR_FIELDS):
        x = x.withColumn(f"_p{i}", F.last(field, ignorenulls=True).over(det.prefix()))
        x = x.withColumns({f"_m{i}": F.avg(f"_p{i}").over(det.year()), f"_s{i}": F.coalesce(F.stddev_samp(f"_p{i}").over(det.year()), F.lit(0.0)), f"_k{i}": F.count(field).over(det.year())})
        takes = (F.col(f"_s{i}") >= 1e-9) & (F.col(f"_k{i}") > 50)
        total = total + F.when(takes, sign * (F.col(f"_p{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(0.0)
        used = used + takes.cast("int")
    x = x.withColumn("idx", F.when(used >= 3, total / used))
    return x.withColumn("roll", c.rolling(F.avg, "idx", c.centered(det.in_year(), 30), 15)).drop(*[f"_{k}{i}" for k in "pmsk" for i in range(len(PRECURSOR_FIELDS))])


def index_level(x: str = "roll") -> Column:
    """Mean and one and a half deviations of the dry season; 0.25 with fewer than five values."""
    dry = F.when(F.col("dopy").between(*DRY), F.col(x))
    return F.when(F.count(dry).over(det.year()) >= 5, F.avg(dry).over(det.year()) + 1.5 * F.stddev_samp(dry).over(det.year())).otherwise(0.25)


def index_season(index: DataFrame, up: bool, eps: float = 0.025) -> DataFrame:
    """B1: the persistence index reaches (or leaves) its level and holds."""
    x = of_year(index).withColumn("_level", index_level())
    return det.persistent(x, "roll", F.col("_level"), *(ONSET if up else OFFSET), 14, 9, up, eps)


def falling_dryness(daily: DataFrame) -> DataFrame:
    """M4: the seven-day slope of vpd, smoothed over five days, falls two deviations below its dry-season mean and stays there."""
    x = det.rolling_slope(of_year(daily), "vpd", 7, 4).withColumn("_s", c.rolling(F.avg, "slope", c.centered(det.in_year(), 5), 3))
    dry = F.when(F.col("dopy").between(*DRY_WIND), F.col("_s"))
    x = x.withColumn("_level", F.when(F.count(dry).over(det.year()) >= 10, F.avg(dry).over(det.year()) - 2 * (F.stddev_pop(dry).over(det.year()) + 1e-9)))
    ahead = det.in_year().rowsBetween(0, 6)
    later = F.row_number().over(det.in_year()) > 1
    hit = later & F.col("dopy").between(*SEARCH) & (F.col("_s") < F.col("_level")) & (F.count("_s").over(ahead) >= 5) & (F.avg("_s").over(ahead) < F.col("_level"))
    return det.first_day(x.withColumn("_hit", hit), F.col("_hit"))


def precursor_cusum(index: DataFrame, start: int = 90, slack: float = 0.5, limit: float = 3.0) -> DataFrame:
    """M5: CUSUM of the rolled precursor index above its dry season, begun anew after day `start`; five days above 0.7 limits confirm."""
    x = index.where(F.col("dopy").between(DRY_WIND[0], SEARCH[1]))
    x = x.withColumn("_x", F.coalesce("roll", F.avg("roll").over(det.year())))
    base = F.when(F.col("dopy").between(*DRY_WIND), F.col("_x"))
    x = x.withColumns({"_m": F.avg(base).over(det.year()), "_sd": F.stddev_pop(base).over(det.year()) + 1e-9, "_k": F.count(base).over(det.year()), "_rows": F.count("*").over(det.year())})
    first = F.min(F.when(F.col("dopy") >= start, F.col("date"))).over(det.year())
    x = x.withColumn("_begun", F.col("date") > first)
    x = x.withColumn("_sum", F.sum(F.when(F.col("_begun"), F.col("_x") - F.col("_m") - slack * F.col("_sd")).otherwise(0.0)).over(det.prefix()))
    x = x.withColumn("_c", F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(det.prefix())))
    ahead = det.in_year().rowsBetween(0, 4)
    hit = F.col("_begun") & (F.col("_k") >= 10) & (F.col("_rows") >= 30) & (F.col("_c") > limit * F.col("_sd")) & (F.min("_c").over(ahead) > 0.7 * limit * F.col("_sd"))
    return det.first_day(x.withColumn("_hit", hit), F.col("_hit"))


def precursor_likelihood(index: DataFrame, share: float = 0.5, cap: float = 300.0) -> DataFrame:
    """M2: Shiryaev-Roberts on the rolled precursor index between two normal laws, from day 60; alarm at share * rows.

    The second mean is that of days 150 to 200, or one deviation above the first with fewer than five values there.
    """
    x = index.where(F.col("dopy").between(DRY_WIND[0], SEARCH[1]))
    x = x.withColumn("_x", F.coalesce("roll", F.avg("roll").over(det.year())))
    base, west = F.when(F.col("dopy").between(*DRY_WIND), F.col("_x")), F.when(F.col("dopy").between(150, 200), F.col("_x"))
    x = x.withColumns({"_m": F.avg(base).over(det.year()), "_sd": F.stddev_pop(base).over(det.year()) + 1e-9, "_k": F.count(base).over(det.year()), "_n": F.count("*").over(det.year())})
    x = x.withColumn("_w", F.when(F.count(west).over(det.year()) >= 5, F.avg(west).over(det.year())).otherwise(F.col("_m") + F.col("_sd")))
    x = x.withColumn("_l", (2 * F.col("_x") * (F.col("_w") - F.col("_m")) - F.col("_w") * F.col("_w") + F.col("_m") * F.col("_m")) / (2 * F.col("_sd") * F.col("_sd")))
    x = x.withColumn("_sum", F.sum("_l").over(det.prefix())).withColumn("_before", F.col("_sum") - F.col("_l"))
    # R_t = exp(S_t) * sum of exp(-S_k) over the k before t; each row's sum is taken around the least S so far, which dominates it
    x = x.withColumn("_low", F.min("_before").over(det.year()))
    log_r = F.col("_sum") - F.col("_low") + F.log(F.sum(F.exp(F.greatest(F.col("_low") - F.col("_before"), F.lit(-cap)))).over(det.prefix()))
    hit = (F.col("_k") >= 10) & (F.col("_n") >= 30) & (log_r >= F.log(share * F.col("_n")))
    return det.first_day(x.withColumn("_hit", hit), F.col("_hit"))


def season_table(daily: DataFrame, detectors=SEASON_DETECTORS, least_days: int = 0) -> DataFrame:
    """Runner: (py, method, onset) of all given detectors, one row for each year (of `least_days` days, all by default) and method."""
    out, daily = None, complete(daily, least_days)
    for d in detectors:
        one = detected(daily, d).select("py", F.lit(d.name).alias("method"), F.col("onset").cast("double").alias("onset"))
        out = one if out is None else out.unionByName(one)
    return out


def reversal_table(daily: DataFrame, least_days: int = REVERSAL_DAYS) -> DataFrame:
    """Runner: (py, method, onset) of the precursor methods M2 and M4 to M10, for years of enough days."""
    daily = complete(daily, least_days)
    index = precursor_index(daily)
    every = [("M2_likelihood", precursor_likelihood(index)), ("M4_falling_dryness", falling_dryness(daily)), ("M5_cusum", precursor_cusum(index))]
    every += [(name, crossed(daily, rule)) for name, rule in zip(CROSSING_NAMES, CROSSING_DETECTORS, strict=True)]
    out = None
    for name, df in every:
        one = df.select("py", F.lit(name).alias("method"), F.col("onset").cast("double").alias("onset"))
        out = one if out is None else out.unionByName(one)
    return out


def comparison(table: DataFrame, methods: list[str]) -> DataFrame:
    """A row for each year with a column for each method, how many found a day, and the mean and spread of the days found."""
    return table.groupBy("py").agg(*[F.max(F.when(F.col("method") == m, F.col("onset"))).alias(m) for m in methods], F.count("onset").alias("found"), F.avg("onset").alias("mean"), F.stddev_samp("onset").alias("spread"))
