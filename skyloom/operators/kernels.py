"""Sequential and spectral kernels, as grouped maps: one group is one seasonal year or one station's daily series.

These are the recursions that no window expresses. Spark partitions the groups; a group is a few hundred to a few
thousand daily rows, which the aggregation before guarantees. Each function takes a long table with `py` and `date`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(x: np.ndarray) -> np.ndarray:
    """Missing values take the mean of the others."""
    x = np.asarray(x, float)
    ok = np.isfinite(x)
    return np.where(ok, x, x[ok].mean() if ok.any() else 0.0)


def optimal_breaks(x: np.ndarray, penalty: float) -> list[int]:
    """Breaks of the piecewise-constant fit with the least squared error plus a penalty a piece, exact, with pruning."""
    x = filled(x)
    n = len(x)
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    best, back = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    starts = np.array([0])
    for t in range(1, n + 1):
        cost = best[starts] + q[t] - q[starts] - (s[t] - s[starts]) ** 2 / (t - starts)
        k = int(cost.argmin())
        best[t], back[t] = cost[k] + penalty, starts[k]
        starts = np.append(starts[cost <= best[t]], t)
    out = []
    t = int(back[n])
    while t > 0:
        out.append(t)
        t = int(back[t])
    return out[::-1]


def breaks(df: DataFrame, x: str, low: int = 60, high: int = 330, after: int = 120, scale: float = 1.5, least: int = 30) -> DataFrame:
    """First break of each year after the seasonal day `after`; the penalty is scale * ln(n) * variance."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        g = g[(g["dopy"] >= low) & (g["dopy"] <= high)]
        v, onset, n = g["x"].to_numpy(float), None, 0
        if len(v) >= least and np.isfinite(v).any():
            found = optimal_breaks(v, scale * math.log(len(v)) * max(float(np.nanvar(v)), 1e-6))
            n = len(found)
            onset = next((float(g["dopy"].iloc[b]) for b in found if b < len(v) and g["dopy"].iloc[b] > after), None)
        return pd.DataFrame({"onset": [onset], "n_breaks": [n], "py": [int(g["py"].iloc[0]) if len(g) else -1]})

    rows = df.select("py", "date", "dopy", F.col(x).alias("x"))
    return rows.groupBy("py").applyInPandas(one, "onset double, n_breaks long, py long").where("py >= 0")


# Fixed values of the ensemble: tuning constant, rounds, least spread and least movement (days).
BISQUARE, ROUNDS, LEAST_SPREAD, LEAST_MOVE = 4.685, 10, 0.5, 0.1


def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.element_at(values, F.floor((n + 1) / 2).cast("int")) + F.element_at(values, F.floor(n / 2).cast("int") + 1)) / 2


def _next_centre(rows: Column, centre: Column) -> Column:
    """One reweighting around `centre` of rows (v, w); null where the spread or all weights are too small to go on."""
    spread = _middle(F.array_sort(F.transform(rows, lambda r: F.abs(r["v"] - centre))))
    bell = lambda r: r["w"] * F.pow(F.greatest(1 - F.pow((r["v"] - centre) / (BISQUARE * spread), 2), F.lit(0.0)), 2)
    mass = F.aggregate(rows, F.lit(0.0), lambda t, r: t + bell(r))
    return F.when((spread >= LEAST_SPREAD) & (mass >= 1e-10), F.aggregate(rows, F.lit(0.0), lambda t, r: t + bell(r) * r["v"]) / mass)


def biweight(df: DataFrame, value: str = "onset", weight: str = "weight") -> DataFrame:
    """(py, ensemble, n): the weighted mean of two or three estimates of a year; of more, Tukey's biweight around their weighted median.

    The estimates of a year are one short array (one for each method), and the rounds fold over it, so no row leaves the JVM.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    known = F.when(v.isNotNull() & (w > 0), F.struct(v.alias("v"), w.alias("w")))
    rows = df.groupBy("py").agg(F.array_sort(F.collect_list(known)).alias("rows"), F.count(v).alias("n"))
    total = F.aggregate("rows", F.lit(0.0), lambda t, r: t + r["w"])
    rows = rows.withColumn("rows", F.transform("rows", lambda r: F.struct(r["v"].alias("v"), (r["w"] / total).alias("w")))).withColumn("k", F.size("rows"))
    mean = F.aggregate("rows", F.lit(0.0), lambda t, r: t + r["w"] * r["v"])
    start = F.aggregate(
        "rows", F.struct(F.lit(0.0).alias("below"), F.lit(None).cast("double").alias("at")),
        lambda t, r: F.struct((t["below"] + r["w"]).alias("below"), F.coalesce(t["at"], F.when(t["below"] + r["w"] >= 0.5, r["v"])).alias("at")),
    )["at"]
    seeded = rows.withColumn("seed", F.coalesce(start, F.element_at(F.col("rows"), F.greatest(F.col("k"), F.lit(1)))["v"]))

    def turn(state: Column, _: Column) -> Column:
        new = F.when(~state["done"], _next_centre(F.col("rows"), state["centre"]))
        return F.struct(F.coalesce(new, state["centre"]).alias("centre"), (state["done"] | new.isNull() | (F.abs(new - state["centre"]) < LEAST_MOVE)).alias("done"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.col("seed").alias("centre"), F.lit(False).alias("done")), turn)["centre"]
    return seeded.select("py", F.when(F.col("k") >= 4, folded).when(F.col("k") >= 2, mean).alias("ensemble"), F.col("n"))


def log_normal(z: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of a multivariate normal with a small ridge."""
    cov = cov + 1e-6 * np.eye(len(mean))
    d = z - mean
    return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1] + len(mean) * math.log(2 * math.pi))


def causal_filter(z: np.ndarray, start, move, means, covs) -> np.ndarray:
    """Probabilities of the hidden states given the rows so far; a step whose weights all vanish falls back to the prediction."""
    dens = np.stack([log_normal(z, np.asarray(m, float), np.asarray(s, float)) for m, s in zip(means, covs, strict=True)], axis=1)
    move, p, out = np.asarray(move, float), np.asarray(start, float), np.zeros_like(dens)
    for t in range(len(z)):
        prior = p if t == 0 else p @ move
        w = prior * np.exp(dens[t] - dens[t].max())
        p = w / w.sum() if w.sum() > 0 else prior / max(prior.sum(), 1e-300)
        out[t] = p
    return out


#: A model of two states on one standardised feature, for the registered query. A model of any size is a parameter.
TWO_STATES = {"start": [0.5, 0.5], "move": [[0.97, 0.03], [0.03, 0.97]], "means": [[-0.6], [0.6]], "covs": [[[0.8]], [[0.8]]]}


def hidden_states(df: DataFrame, features: list[str], model: dict = TWO_STATES, warm_days: int = 180, warm_least: int = 90) -> DataFrame:
    """State probabilities of each year, filtered from `warm_days` before it; with fewer than `warm_least` rows there, from its first day.

    A row belongs to its own year and, as warm-up, to the next one, so rows are copied to the slices that need them first.
    """
    rows = df.select("py", "date", "dopy", *features)
    anchor = F.make_date((F.col("py") + 1).cast("int"), F.lit(6), F.lit(22))
    warm = rows.where(F.datediff(anchor, "date") <= warm_days).withColumn("slice", F.col("py") + 1).withColumn("own", F.lit(False))
    both = rows.withColumn("slice", F.col("py")).withColumn("own", F.lit(True)).unionByName(warm)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        start = model["start"]
        if (~g["own"]).sum() < warm_least:
            g, start = g[g["own"]], np.eye(len(model["start"]))[0]
        empty = pd.DataFrame({"py": np.zeros(0, np.int64), "date": np.zeros(0, object), "state": np.zeros(0, np.int64), "p": np.zeros(0)})
        if g["own"].sum() < 30:
            return empty
        p = causal_filter(np.nan_to_num(g[features].to_numpy(float)), start, model["move"], model["means"], model["covs"])
        own = g["own"].to_numpy()
        return pd.DataFrame({"py": g["slice"][own], "date": g["date"][own], "state": p[own].argmax(axis=1), "p": p[own].max(axis=1)})

    return both.groupBy("slice").applyInPandas(one, "py long, date date, state long, p double")


@dataclass(frozen=True)
class TrendNoise:
    """Variances of level and trend, of the first state, and the ARCH law of the noise: omega + alpha * gap**2, at least `floor`. Fixed values."""

    level: float = 0.8
    trend: float = 0.02
    first: float = 400.0
    omega: float = 5.0
    alpha: float = 0.3
    floor: float = 1.0


#: Level, trend and the lower root of their covariance (top, side, corner).
TrendState = tuple[float, float, float, float, float]


def first_trend(value: float, noise: TrendNoise) -> TrendState:
    return value, 0.0, math.sqrt(noise.first), 0.0, math.sqrt(noise.first)


def next_trend(state: TrendState, seen: float, noise: TrendNoise) -> TrendState:
    """One step of the square-root filter of a local linear trend of which the level is seen.

    Only the level is measured, so with the predicted root [[top, 0], [side, corner]] the gain is along (top, side), and the
    update shrinks just these two by sqrt(r / (top**2 + r)); the corner stays.
    """
    level, trend, top, side, corner = state
    lead = top + side
    top_now = math.sqrt(lead * lead + corner * corner + noise.level)
    side_now = (lead * side + corner * corner) / top_now
    corner_now = math.sqrt(max(side * side + corner * corner + noise.trend - side_now * side_now, 0.0))
    gap = seen - (level + trend)
    r = max(noise.floor, noise.omega + noise.alpha * gap * gap)
    pull = gap * top_now / (top_now * top_now + r)
    shrink = math.sqrt(r / (top_now * top_now + r))
    return level + trend + top_now * pull, trend + side_now * pull, top_now * shrink, side_now * shrink, corner_now


def local_trend(y: np.ndarray, noise: TrendNoise = TrendNoise()) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """Level and trend after each value."""
    path, state = np.empty((len(y), 2)), first_trend(float(y[0]), noise) if len(y) else None
    for t, seen in enumerate(np.asarray(y, float).tolist()):
        state = next_trend(state, seen, noise)
        path[t] = state[:2]
    return path[:, 0], path[:, 1]


def smoothed(df: DataFrame, x: str, burn_in: int = 60, key: str = "station", noise: TrendNoise = TrendNoise()) -> DataFrame:  # noqa: B008
    """Level and trend for each row of each `key`, null in the first `burn_in` rows."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        level, trend = local_trend(filled(g["x"].to_numpy(float)), noise)
        level[:burn_in], trend[:burn_in] = np.nan, np.nan
        return pd.DataFrame({key: g[key], "date": g["date"], "level": level, "trend": trend})

    out = df.select(key, "date", F.col(x).alias("x")).groupBy(key).applyInPandas(one, f"{key} long, date date, level double, trend double")
    return out.select(key, "date", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("level", "trend")])


def lagged_forecast(df: DataFrame, x: str, y: str, back: int = 4, ahead: int = 6, key: str = "station") -> DataFrame:
    """Least squares of y `ahead` rows on from the last back + 1 rows of x and y, and the forecast from the latest rows.

    Lags are windows and products are aggregates, so the fit is one pass: only the small normal equations are solved in Python.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("date")
    names = [f"x{i}" for i in range(back + 1)] + [f"y{i}" for i in range(back + 1)]
    lags = df.withColumns({f"x{i}": F.lag(x, i).over(w) for i in range(back + 1)} | {f"y{i}": F.lag(y, i).over(w) for i in range(back + 1)} | {"target": F.lead(y, ahead).over(w), "one": F.lit(1.0)}).where(" and ".join(f"{n} is not null" for n in names))
    terms = [*names, "one"]
    sums = [F.sum(F.when(F.col("target").isNotNull(), F.col(a) * F.col(b))).alias(f"s_{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    sums += [F.sum(F.col(a) * F.col("target")).alias(f"t_{i}") for i, a in enumerate(terms)]
    latest = F.max(F.struct("date", F.array(*terms).alias("v"))).alias("latest")
    g = lags.groupBy(key).agg(*sums, F.count("target").alias("n"), latest)
    k = len(terms)

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                a = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                beta = np.linalg.lstsq(a, np.array([r[f"t_{i}"] for i in range(k)], float), rcond=None)[0]
                out.append((r[key], r["n"], float(np.asarray(r["v"], float) @ beta), r["date"]))
            yield pd.DataFrame(out, columns=[key, "n", "forecast", "latest"])

    return g.select("*", F.col("latest.v").alias("v"), F.col("latest.date").alias("date")).drop("latest").mapInPandas(solve, f"{key} long, n long, forecast double, latest date")


def interaction_fit(df: DataFrame, a: str, b: str, y: str, least: int = 4) -> DataFrame:
    """Least squares of y on a, b, a * b and a constant: coefficients and r squared from one aggregate row.

    Moments are centred: raw sums lose the coefficients where a and b vary little around large means.
    """
    rows = df.where(f"{a} is not null and {b} is not null and {y} is not null").select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col(a) * F.col(b)).alias("ab"), F.col(y).alias("y"))
    t = ("a", "b", "ab", "y")
    sums = rows.agg(F.count("*").alias("n"), *[F.avg(p).alias(p) for p in t], *[F.covar_pop(p, q).alias(f"{p}_{q}") for i, p in enumerate(t) for q in t[i:]])

    def solve(batches):
        for g in batches:
            out = []
            for r in g.to_dict("records"):
                if r["n"] < least:
                    continue
                m = np.array([[r.get(f"{p}_{q}", r.get(f"{q}_{p}")) for q in t[:3]] for p in t[:3]], float)
                v = np.array([r[f"{p}_y"] for p in t[:3]], float)
                unit = np.sqrt(np.diag(m))
                unit[unit == 0] = 1.0
                beta = np.linalg.lstsq(m / np.outer(unit, unit), v / unit, rcond=None)[0] / unit
                constant = r["y"] - float(beta @ [r[p] for p in t[:3]])
                out.append((*map(float, beta), constant, float(beta @ v) / r["y_y"] if r["y_y"] > 0 else None, int(r["n"])))
            yield pd.DataFrame(out, columns=["beta_a", "beta_b", "beta_ab", "constant", "r2", "n"])

    return sums.mapInPandas(solve, "beta_a double, beta_b double, beta_ab double, constant double, r2 double, n long")


def spectrum(df: DataFrame, x: str, time: str = "hour", key: str = "station", top: int = 10, longest: float = 720.0) -> DataFrame:
    """The `top` periods (rows) by amplitude of the detrended series of each key, gaps filled by position."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        v = g["x"].interpolate("linear", limit_direction="both").to_numpy(float)
        amp, freq = np.abs(np.fft.rfft(v - v.mean())), np.fft.rfftfreq(len(v))
        ok = np.flatnonzero((freq > 0) & (freq >= 1 / longest))
        best = ok[np.lexsort((ok, -amp[ok]))][:top]
        power = float((amp[ok] ** 2).sum())
        return pd.DataFrame({key: g[key].iloc[0], "rank": np.arange(1, len(best) + 1), "period": 1 / freq[best], "amplitude": amp[best], "power_pct": 100 * amp[best] ** 2 / power if power else 0.0})

    return df.select(key, F.col(time).alias("t"), F.col(x).alias("x")).groupBy(key).applyInPandas(one, f"{key} long, rank long, period double, amplitude double, power_pct double")


def welch(v: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean periodogram of half-overlapping segments: Hann window, each segment's mean removed, one-sided density."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = np.lib.stride_tricks.sliding_window_view(v, segment)[:: segment - segment // 2]
    p = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 / (window**2).sum()
    p[:, 1 : -1 if segment % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(segment), p.mean(axis=0)


def density(df: DataFrame, x: str, time: str = "hour", key: str = "station", top: int = 5) -> DataFrame:
    """The strongest periods of the Welch density of each key; segments of a quarter of the series."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("t")["x"].interpolate("linear", limit_direction="both").to_numpy(float)
        freq, p = welch(v - v.mean(), max(8, min(8760, len(v) // 4)))
        best = [i for i in np.lexsort((np.arange(len(p)), -p)) if freq[i] > 0][:top]
        return pd.DataFrame({key: g[key].iloc[0], "rank": np.arange(1, len(best) + 1), "period": 1 / freq[best], "psd": p[best]})

    return df.select(key, F.col(time).alias("t"), F.col(x).alias("x")).groupBy(key).applyInPandas(one, f"{key} long, rank long, period double, psd double")
