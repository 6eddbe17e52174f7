"""Seasons by hidden states: rolled features, a model estimated from labelled days, posteriors by year, onset and offset rules.

Windows have the place as their key, and a group of the filter is one place's seasonal year with its warm-up, so many
places and years run side by side. The rules read posteriors with windows, not in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators.kernels import causal_filter

#: Rolled rows, and the least that must be known; days before a year that warm the filter, and the least of them. Fixed values.
ROWS, LEAST, WARM_DAYS, WARM_LEAST, YEAR_DAYS = 30, 15, 180, 90, 365
#: Rows that a year must have with its warm-up, and without. Fixed values.
LEAST_ROWS, LEAST_OWN = 60, 30


@dataclass(frozen=True)
class Feature:
    """Trailing sum or mean of a daily field; `fill` carries the last known value over gaps first."""

    name: str
    field: str
    kind: str = "mean"
    fill: bool = False


#: The four features of the small model and the nine of the large one. Fixed values.
FOUR = (Feature("r_30", "precip", "sum"), Feature("tc_30", "tcwv", fill=True), Feature("cl_30", "cloud", fill=True), Feature("u_30", "u_comp"))
NINE = (
    Feature("r_30", "precip", "sum"), Feature("wb_30", "wb", "sum"), Feature("sm_30", "sm_0_7", fill=True), Feature("rh_30", "rh"), Feature("tc_30", "tcwv", fill=True),
    Feature("dt_30", "dtr", fill=True), Feature("cl_30", "cloud", fill=True), Feature("sd_30", "sm_28_100", fill=True), Feature("u_30", "u_comp"),
)


def rolled(daily: DataFrame, features: tuple[Feature, ...], key: str = "place") -> DataFrame:
    """key, date and the features of the days on which all are known."""
    along = Window.partitionBy(key).orderBy("date")
    carried = daily.withColumns({f"_{f.name}": c.forward_fill(f.field, along) if f.fill else F.col(f.field) for f in features})
    frame = c.trailing(along, ROWS)
    cols = [c.rolling(F.sum if f.kind == "sum" else F.avg, f"_{f.name}", frame, LEAST).alias(f.name) for f in features]
    return carried.select(key, "date", *cols).where(" and ".join(f"{f.name} is not null" for f in features))


@dataclass(frozen=True)
class Model:
    """Hidden states on standardised features: start and transition probabilities, means and covariances, and the standardisation."""

    names: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    start: tuple[float, ...]
    move: tuple[tuple[float, ...], ...]
    means: tuple[tuple[float, ...], ...]
    covs: tuple[tuple[tuple[float, ...], ...], ...]

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.centre)) / np.array(self.scale)


#: First seasonal days of the four states that label the days a model is estimated from: dry, rains begin, wet, rains end; the first one wraps. Fixed values.
LABELS = ((1, 80), (2, 150), (3, 250), (0, 310))


def labelled(day: Column) -> Column:
    found = F.lit(0)
    for state, low in LABELS:
        found = F.when(day >= low, state).otherwise(found)
    return found


def estimated(features: DataFrame, names: tuple[str, ...], state: Column, states: int = 4, key: str = "place", first: int = 2) -> Model:
    """A model from days whose state is given: two aggregates of all days, whose few numbers reach the driver.

    The filter's first state is `first`, as the warm-up begins in the middle of the wet season.
    """
    every = features.agg(*[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names]).first()
    centre, scale = tuple(every[: len(names)]), tuple(s or 1.0 for s in every[len(names) :])
    z = features.withColumns({n: (F.col(n) - m) / s for n, m, s in zip(names, centre, scale, strict=True)}).withColumn("_s", state)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = {r["_s"]: r for r in z.groupBy("_s").agg(*[F.avg(n).alias(n) for n in names], *[F.covar_pop(a, b).alias(f"{a} {b}") for a, b in pairs]).collect()}
    means = tuple(tuple(rows[s][n] if s in rows else 0.0 for n in names) for s in range(states))
    covs = tuple(tuple(tuple((rows[s][f"{a} {b}" if (a, b) in pairs else f"{b} {a}"] if s in rows else 0.0) + (0.05 if a == b else 0.0) for b in names) for a in names) for s in range(states))
    step = z.withColumn("_to", F.lead("_s").over(Window.partitionBy(key).orderBy("date"))).where("_to is not null").groupBy("_s", "_to").count().collect()
    move = np.full((states, states), 1e-6)
    for r in step:
        move[r["_s"], r["_to"]] += r["count"]
    move /= move.sum(axis=1, keepdims=True)
    return Model(tuple(names), centre, scale, tuple(float(s == first) for s in range(states)), tuple(map(tuple, move.tolist())), means, covs)


def year_posteriors(sub: pd.DataFrame, model: Model) -> np.ndarray | None:
    """Probabilities of the states for the rows of the year itself; `sub` has `own` and the features, in order of date.

    With too few rows before the year the filter starts on its first day, in state 0.
    """
    start = np.array(model.start)
    if len(sub) < LEAST_ROWS:
        return None
    if (~sub["own"]).sum() < WARM_LEAST:
        sub, start = sub[sub["own"]], np.eye(len(model.start))[0]
        if len(sub) < LEAST_ROWS:
            return None
    own = sub["own"].to_numpy()
    if own.sum() < LEAST_OWN:
        return None
    start = (start + 1e-12) / (start + 1e-12).sum()
    p = causal_filter(model.standardised(sub[list(model.names)].to_numpy(float)), start, model.move, model.means, model.covs)
    return p[own]


def posteriors(features: DataFrame, model: Model, key: str = "place") -> DataFrame:
    """key, py, date, dopy and p (array of all states) of each seasonal year, filtered from its warm-up on.

    A day belongs to its own year and, as warm-up, to the next one: it is copied to both, and years are independent groups.
    """
    own = c.season_year("date")
    day = c.season_day("date")
    rows = features.withColumns({"py": own, "_day": day}).where(F.col("_day") < YEAR_DAYS)
    to_next = F.datediff(F.make_date((own + 1).cast("int"), F.lit(c.ANCHOR_MONTH), F.lit(c.ANCHOR_DAY)), "date")
    warm = features.withColumns({"py": own + 1, "_day": -to_next.cast("long")}).where(to_next <= WARM_DAYS)
    both = rows.withColumn("own", F.lit(True)).unionByName(warm.withColumn("own", F.lit(False)))
    kind = features.schema[key].dataType.simpleString()

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_day")
        p = year_posteriors(g, model)
        kept = g[g["own"]] if p is not None else g[:0]
        return pd.DataFrame({key: kept[key], "py": kept["py"], "date": kept["date"], "dopy": kept["_day"], "p": pd.Series(list(p) if p is not None else [], index=kept.index, dtype=object)})

    return both.select(key, "py", "date", "_day", "own", *model.names).groupBy(key, "py").applyInPandas(one, f"{key} {kind}, py long, date date, dopy long, p array<double>")


@dataclass(frozen=True)
class SeasonRule:
    """Windows of the seasonal day and levels of the posteriors. Fixed values."""

    onset_window: tuple[int, int] = (100, 195)
    first_state: int = 1
    full_state: int = 2
    onset_level: float = 0.70
    after_first: float = 25.0
    before_full: float = 40.0
    offset_window: tuple[int, int] = (170, 330)
    last_state: int = 3
    offset_level: float = 0.60
    hold: int = 7
    misses: int = 2
    slack: float = 0.85
    fallback: float = 0.8


def seasons(p: DataFrame, rule: SeasonRule = SeasonRule(), key: str = "place") -> DataFrame:  # noqa: B008
    """key, py, onset and offset (seasonal days) of every filtered year.

    Onset: the first day in its window on which the first state is likely, and 25 days; else 40 days before the wet state is.
    Offset: the first day on which the last state is likely and stays so for the next rows of the window; else its likeliest day.
    """
    at = lambda s: F.get("p", F.lit(s))
    low, high = rule.onset_window
    inside = p.where(F.col("dopy").between(low, high))
    firsts = inside.groupBy(key, "py").agg(
        F.min(F.when(at(rule.first_state) >= rule.onset_level, F.struct("date", "dopy")))["dopy"].alias("i1"), F.min(F.when(at(rule.full_state) >= rule.onset_level, F.struct("date", "dopy")))["dopy"].alias("i2")
    )
    onset = firsts.select(key, "py", F.coalesce(F.col("i1") + rule.after_first, F.when(F.col("i2").isNotNull(), F.greatest(F.lit(float(low)), F.col("i2") - rule.before_full))).alias("onset"))
    last = at(rule.last_state)
    ahead = Window.partitionBy(key, "py").orderBy("date").rowsBetween(0, rule.hold - 1)
    late = p.where(F.col("dopy").between(*rule.offset_window)).withColumn("_x", last)
    held = late.withColumn("_n", F.count_if(F.col("_x") >= rule.offset_level * rule.slack).over(ahead))
    found = held.groupBy(key, "py").agg(
        F.min(F.when((F.col("_x") >= rule.offset_level) & (F.col("_n") >= rule.hold - rule.misses), F.struct("date", "dopy")))["dopy"].alias("kept"),
        F.min(F.struct(-F.col("_x"), "date", "dopy"))["dopy"].alias("peak"), F.max("_x").alias("most"),
    )
    offset = found.select(key, "py", F.coalesce("kept", F.when(F.col("most") >= rule.offset_level * rule.fallback, F.col("peak"))).cast("double").alias("offset"))
    years = p.select(key, "py").distinct()
    return years.join(onset, [key, "py"], "left").join(offset, [key, "py"], "left")
