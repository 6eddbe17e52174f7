"""Onset by a low-passed wind vector: a long zero-padded kernel, direction and its turning, a threshold by recovery, and a gate of active days.

The kernel meets a row's neighbours in a window of bounded width, as a fold over two arrays, so rows are not multiplied
by the kernel's length and nothing is joined. Places are keys of all windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators.detectors import lanczos_kernel
from skyloom.operators.intervals import overlapping, runs

TAPS, CUTOFF_DAYS = 241, 80.0


@dataclass(frozen=True)
class PhaseRule:
    """Fixed values."""

    dry: tuple[int, int] = (60, 120)
    wet: tuple[int, int] = (180, 280)
    search: tuple[int, int] = (60, 200)
    least_rows: int = 60
    least_days: int = 10
    least_range: float = 0.05
    small_range: float = 0.15
    small_threshold: float = 0.02
    recovery: float = 0.20
    active: float = 2.0


def interpolated(x: str, order: Window, number: Column) -> Column:
    """Gaps filled by position between the known neighbours; the ends take the nearest known value."""
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(x).isNotNull(), F.struct(number.alias("n"), F.col(x).alias("v")))
    a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(on)
    between = a["v"] + (b["v"] - a["v"]) * (number - a["n"]) / (b["n"] - a["n"])
    return F.when(F.col(x).isNotNull(), F.col(x)).when(a.isNotNull() & b.isNotNull(), between).otherwise(F.coalesce(a["v"], b["v"]))


def low_passed(df: DataFrame, fields: tuple[str, ...], key: str, taps: int = TAPS, cutoff_days: float = CUTOFF_DAYS) -> DataFrame:
    """`df` with low_<field> for each field: gaps interpolated, then convolved; beyond the ends counts as zero, nothing is renormalised."""
    order = Window.partitionBy(key).orderBy("date")
    rows = df.withColumn("rn", F.row_number().over(order).cast("long"))
    filled = rows.withColumns({f"_{f}": interpolated(f, order, F.col("rn")) for f in fields})
    half = taps // 2
    weights = F.array(*[F.lit(w) for w in lanczos_kernel(taps, 1.0 / cutoff_days)])
    around = order.rowsBetween(-half, half)
    first = F.min("rn").over(around)
    gathered = filled.withColumns({f"_l{f}": F.collect_list(F.coalesce(f"_{f}", F.lit(0.0))).over(around) for f in fields} | {"_s": (half - (F.col("rn") - first) + 1).cast("int")})
    fold = lambda f: F.aggregate(F.zip_with(f"_l{f}", F.slice(weights, F.col("_s"), F.size(f"_l{f}")), lambda x, w: x * w), F.lit(0.0), lambda t, v: t + v)
    return gathered.withColumns({f"low_{f}": F.when(F.col(f"_{f}").isNotNull(), fold(f)) for f in fields}).drop(*[f"_{f}" for f in fields], *[f"_l{f}" for f in fields], "_s")


def with_direction(df: DataFrame, u: str, v: str, key: str) -> DataFrame:
    """`df` with the direction of the vector and `turned`, the same angle unwrapped: no step of more than half a circle, whole turns added up."""
    order = Window.partitionBy(key).orderBy("date")
    angle = df.withColumn("direction", F.pmod(F.degrees(F.atan2(u, v)) + 180, F.lit(360.0)))
    step = F.col("direction") - F.lag("direction").over(order)
    crossed = F.when(step > 180, -1).when(step < -180, 1).otherwise(0)
    return angle.withColumn("_turn", crossed).withColumn("turned", F.col("direction") + 360.0 * F.sum("_turn").over(order)).drop("_turn")


def onsets(low: DataFrame, phases: DataFrame, u: str, key: str, rule: PhaseRule = PhaseRule()) -> DataFrame:  # noqa: B008
    """key, py, threshold, onset (seasonal day) and gated, the upward crossings before it that fell on an active day.

    The threshold is the dry season's least value and a share of the range up to the wet season's largest; years of too few
    rows or too small a range have none. A crossing on a day within a run of the phase index at or above `active` does not count.
    """
    order = Window.partitionBy(key, "py").orderBy("date")
    rows = low.withColumns({"py": c.season_year("date"), "dopy": c.season_day_mod("date")})
    inside = lambda span: F.col("dopy").between(*span)
    years = rows.groupBy(key, "py").agg(
        F.count("*").alias("n"), F.count_if(inside(rule.dry)).alias("n_dry"), F.count_if(inside(rule.wet)).alias("n_wet"), F.min(F.when(inside(rule.dry), F.col(u))).alias("least"), F.max(F.when(inside(rule.wet), F.col(u))).alias("most")
    )
    reach = F.col("most") - F.col("least")
    enough = (F.col("n") >= rule.least_rows) & (F.col("n_dry") >= rule.least_days) & (F.col("n_wet") >= rule.least_days) & (reach >= rule.least_range)
    limits = years.select(key, "py", F.when(enough, F.when(reach < rule.small_range, rule.small_threshold).otherwise(F.col("least") + rule.recovery * reach)).alias("threshold"))
    marked = rows.withColumns({"_prev": F.lag(u).over(order), "_more": F.lead("date").over(order)}).join(limits, [key, "py"])
    crossing = marked.where(inside(rule.search) & F.col("_more").isNotNull() & (F.col("_prev") < F.col("threshold")) & (F.col(u) >= F.col("threshold"))).select(key, "py", "date", "dopy")
    numbered = phases.withColumns({"active": F.coalesce(F.col("amplitude") >= rule.active, F.lit(False)), "day": F.unix_date("date")})
    closed = overlapping(crossing.withColumns({"low": F.col("date"), "high": F.col("date")}), runs(numbered, "active", "day"), left_ends=("low", "high"), right_ends=("start", "stop")).select(key, "py", "date").withColumn("gated", F.lit(True))
    judged = crossing.join(closed, [key, "py", "date"], "left").withColumn("gated", F.coalesce("gated", F.lit(False)))
    first = judged.groupBy(key, "py").agg(F.min(F.when(~F.col("gated"), F.struct("date", "dopy"))).alias("f"), F.collect_list(F.when(F.col("gated"), F.col("date"))).alias("g"))
    early = F.size(F.filter("g", lambda d: F.coalesce(d < F.col("f.date"), F.lit(True)))).cast("long")
    return limits.join(first.select(key, "py", F.col("f.dopy").alias("onset"), early.alias("gated")), [key, "py"], "left").withColumn("gated", F.coalesce("gated", F.lit(0).cast("long")))
