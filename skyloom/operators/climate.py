"""Climate context of seasonal years: index means and classes, phase-index runs in onset and lead windows, flags and odds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators.intervals import overlapping, runs


@dataclass(frozen=True)
class ContextRule:
    """Fixed values."""

    enso: float = 0.50
    iod: float = 0.40
    amplitude: float = 1.5
    phases: tuple[int, ...] = (5, 6, 7, 8)
    event_days: int = 5
    onset_window: tuple[int, int] = (100, 195)
    lead_days: tuple[int, int] = (7, 15)
    strong: float = 0.75
    sigma: float = 1.5


def first_source(monthly: DataFrame, coarse: DataFrame) -> DataFrame:
    """`monthly` (month, value) if it has any row, else `coarse`: an anti-join against one row, decided when the plan runs."""
    any_row = monthly.limit(1).select(F.lit(1).alias("_one"))
    return monthly.unionByName(coarse.withColumn("_one", F.lit(1)).join(any_row, "_one", "left_anti").drop("_one"))


def season_mean(index: DataFrame, months: tuple[int, ...], name: str, date: str = "date") -> DataFrame:
    """year and the mean of the index over months of that calendar year."""
    return index.where(F.month(date).isin(*months) & F.col("value").isNotNull()).groupBy(F.year(date).cast("long").alias("py")).agg(F.avg("value").alias(name))


def windows_of(years: DataFrame, rule: ContextRule) -> DataFrame:
    """py, kind, low and high of the onset window of each year and of the lead window before it."""
    start = lambda day: F.date_add(F.make_date(F.col("py").cast("int"), F.lit(c.ANCHOR_MONTH), F.lit(c.ANCHOR_DAY)), day)
    low, high = rule.onset_window
    near, far = rule.lead_days
    both = F.array(F.struct(F.lit("onset").alias("kind"), start(low).alias("low"), start(high).alias("high")), F.struct(F.lit("lead").alias("kind"), start(low - far).alias("low"), start(low - near).alias("high")))
    return years.select("py", F.explode(both).alias("w")).select("py", "w.*")


def phase_counts(phases: DataFrame, years: DataFrame, rule: ContextRule = ContextRule()) -> DataFrame:  # noqa: B008
    """py with active days, events, longest run and peak amplitude in the onset window, and whether the lead window is active.

    `phases`: date, phase, amplitude. A run counts with the part that lies in the window; its rows follow one another in the
    index, so a missing day does not end it. Runs are intervals and meet the windows in an interval join.
    """
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date"))
    known = F.coalesce(F.col("phase").isin(*rule.phases) & (F.col("amplitude") >= rule.amplitude), F.lit(False))
    rows = phases.withColumns({"rn": number, "active": known})
    windows = windows_of(years, rule)
    inside = overlapping(rows.withColumns({"start": F.col("date"), "stop": F.col("date")}), windows)
    onset = F.col("kind") == "onset"
    days = inside.groupBy("py").agg(
        F.count_if(onset & F.col("active")).alias("active_days"), F.max(F.when(onset, F.col("amplitude"))).alias("peak_amp"), F.max(~onset & F.col("active")).alias("lead_flag"),
        F.min(F.when(onset, F.col("rn"))).alias("rn_low"), F.max(F.when(onset, F.col("rn"))).alias("rn_high"),
    )
    met = overlapping(runs(rows, "active", "rn"), windows.where(onset)).join(days.select("py", "rn_low", "rn_high"), "py")
    length = F.least("last", "rn_high") - F.greatest("first", "rn_low") + 1
    events = met.withColumn("len", length).where(F.col("len") >= rule.event_days).groupBy("py").agg(F.count("*").alias("n_events"), F.max("len").alias("max_run"))
    zero = {"active_days": F.lit(0).cast("long"), "n_events": F.lit(0).cast("long"), "max_run": F.lit(0).cast("long"), "lead_flag": F.lit(False)}
    joined = years.join(days.drop("rn_low", "rn_high"), "py", "left").join(events, "py", "left")
    return joined.withColumns({n: F.coalesce(F.col(n).cast("boolean" if n == "lead_flag" else "long"), x) for n, x in zero.items()})


def onset_odds(n_events: str = "n_events", lead: str = "lead_flag") -> Column:
    """Rule-based odds of the onset: one half, more with events in the window and before it, at most 0.95."""
    return F.least(F.lit(0.95), F.lit(0.50) + F.when(F.col(lead), 0.15).otherwise(0.0) + F.when(F.col(n_events) >= 2, 0.10).when(F.col(n_events) == 1, 0.05).otherwise(0.0))


def context(years: DataFrame, sst: DataFrame, sla: DataFrame, dipole: DataFrame, phases: DataFrame, rule: ContextRule = ContextRule()) -> DataFrame:  # noqa: B008
    """One row for each py of `years`: means and classes of the indices, their interaction, and the counts and odds of the phase index.

    `sst` and `sla` have date and value, `dipole` has month and value. A year without an index value is neutral.
    """
    means = years.join(season_mean(sst, (8, 9, 10), "sst_aso"), "py", "left").join(season_mean(sla, (8, 9, 10), "sla_aso"), "py", "left").join(season_mean(dipole, (9, 10, 11), "dmi_son", "month"), "py", "left")
    classed = means.withColumns({"enso": c.two_sided_class("sst_aso", rule.enso, "LANINA", "NETRAL", "ELNINO"), "iod": c.two_sided_class("dmi_son", rule.iod, "nIOD", "NETRAL", "pIOD")})
    named = classed.withColumn("interaction", c.interaction("enso", "iod"))
    return named.join(phase_counts(phases, years, rule), "py").withColumn("odds", onset_odds())


def flags(ctx: DataFrame, seasons: DataFrame, rule: ContextRule = ContextRule()) -> DataFrame:  # noqa: B008
    """py and the tokens of a year's anomalies: of strong counteracting years whose onset or duration is far off, of strong synergy, and of an active lead window.

    `seasons`: py, onset, duration. Medians and sample deviations are over all years: one small row.
    """
    spread = seasons.agg(*[f(x).alias(f"{n}_{x}") for x in ("onset", "duration") for n, f in (("med", F.median), ("sd", F.stddev_samp))])
    x = ctx.join(seasons, "py", "left").crossJoin(F.broadcast(spread))
    strong = F.coalesce((F.abs("sst_aso") >= rule.strong) & (F.abs("dmi_son") >= rule.strong), F.lit(False))
    against, along = strong & (F.col("interaction") == "COUNTER"), strong & (F.col("interaction") == "SINERGI")
    off = lambda n: (F.col(f"sd_{n}") > 0) & (F.abs(F.col(n) - F.col(f"med_{n}")) > rule.sigma * F.col(f"sd_{n}"))
    tokens = F.concat_ws(" ", F.when(against & off("onset"), "onset-anomaly"), F.when(against & off("duration"), "duration-anomaly"), F.when(along, "synergy"), F.when(F.col("lead_flag"), "lead"))
    return x.select("py", F.when(tokens == "", "-").otherwise(tokens).alias("flags"))
