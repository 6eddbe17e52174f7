"""Window and closed forms of the detectors against plain loops."""

import datetime
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.operators import detectors as det
from skyloom.operators import kernels as k
from skyloom.operators import monsoon as m


def frame(spark, years: dict[int, list[float | None]]):
    rows = []
    for py, values in years.items():
        for i, v in enumerate(values):
            rows.append((py, datetime.date(py, 6, 22) + datetime.timedelta(days=i), i % 365, v))
    return spark.createDataFrame(rows, "py long, date date, dopy long, v double")


def series(seed: int, n: int = 300, gaps: float = 0.05) -> list[float | None]:
    r = np.random.default_rng(seed)
    x = np.sin(np.arange(n) / 365 * 2 * math.pi - 1.5) * 0.4 + r.normal(0, 0.12, n)
    return [None if r.random() < gaps else float(v) for v in x]


def loop_crossing(values, thr, low, high, sustain, least, eps=0.005):
    for i in range(1, len(values)):
        a, b = values[i - 1], values[i]
        if a is None or b is None or not low <= i <= high or not (a < thr <= b):
            continue
        ahead = values[i : i + sustain]
        seen = [v for v in ahead if v is not None]
        if len(ahead) >= least and len(seen) >= least and min(seen) >= thr - eps:
            return i
    return None


def test_crossing_equals_the_loop(spark):
    years = {2000 + i: series(i) for i in range(20)}
    got = {r["py"]: r["onset"] for r in det.crossing(frame(spark, years), "v", F.lit(0.05), 60, 250, sustain=6, least=4, eps=0.1).collect()}
    want = {py: loop_crossing(v, 0.05, 60, 250, 6, 4, 0.1) for py, v in years.items()}
    assert got == want and any(x is not None for x in want.values())


def test_persistent_equals_the_loop(spark):
    years = {2000 + i: series(i) for i in range(10)}
    got = {r["py"]: r["onset"] for r in det.persistent(frame(spark, years), "v", F.lit(0.1), 50, 280, 10, 8).collect()}

    def loop(values):
        for i in range(1, len(values)):
            if values[i] is None or not 50 <= i <= 280 or values[i] < 0.1:
                continue
            ahead = [v for v in values[i : i + 10] if v is not None]
            if len(ahead) >= 6 and sum(v >= 0.1 for v in ahead) >= 8:
                return i
        return None

    assert got == {py: loop(v) for py, v in years.items()}


def test_cusum_closed_form_equals_the_recursion(spark):
    years = {2000 + i: [v or 0.0 for v in series(i, gaps=0)] for i in range(8)}
    got = {r["py"]: r["onset"] for r in det.cusum(frame(spark, years), "v", slack=0.25, limit=3.0).collect()}
    for py, v in years.items():
        m, s, up, onset = np.mean(v), np.std(v), 0.0, None
        for i, x in enumerate(v):
            up = max(0.0, up + x - m - 0.25 * s)
            if onset is None and up > 3 * s:
                onset = i
        assert got[py] == onset


def test_shiryaev_roberts_closed_form_equals_the_recursion(spark):
    years = {2000 + i: [float(x) for x in np.random.default_rng(i).normal(0, 1, 200) + (np.arange(200) > 120) * 2] for i in range(6)}
    got = {r["py"]: r["onset"] for r in det.shiryaev_roberts(frame(spark, years), "v").collect()}
    for py, v in years.items():
        m, s, r, onset = np.mean(v[:101]), np.std(v[:101]), 0.0, None
        for i, x in enumerate(v):
            r = (1 + r) * math.exp((x - m) / s - 0.5)
            if onset is None and r >= 100:
                onset = i
        assert got[py] == onset


def test_pettitt_finds_a_step(spark):
    v = [0.0 + 0.01 * i % 0.07 for i in range(100)] + [5.0 + 0.01 * i % 0.07 for i in range(100)]
    r = det.pettitt(frame(spark, {2000: v}), "v").first()
    assert r["onset"] == 99 and r["p"] < 0.001


def brute_breaks(x, penalty):
    n = len(x)
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for t in range(1, n + 1):
        for s in range(t):
            if best[s] + cost(s, t) + penalty < best[t] - 1e-12:
                best[t], back[t] = best[s] + cost(s, t) + penalty, s
    out, t = [], back[n]
    while t > 0:
        out.append(t)
        t = back[t]
    return out[::-1]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=40), st.floats(0.5, 10))
def test_pruned_breaks_are_optimal(values, penalty):
    x = np.round(np.array(values), 3)

    def total(breaks):
        cuts = [0, *breaks, len(x)]
        return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + penalty for a, b in zip(cuts, cuts[1:], strict=False))

    assert total(k.optimal_breaks(x, penalty)) == pytest.approx(total(brute_breaks(x, penalty)), abs=1e-6)


def test_local_trend_follows_a_ramp():
    level, trend = k.local_trend(np.arange(400) * 0.5 + 3.0)
    assert abs(level[-1] - (399 * 0.5 + 3)) < 1.0 and abs(trend[-1] - 0.5) < 0.05


def test_causal_filter_prefers_the_right_state():
    z = np.concatenate([np.full(40, -1.0), np.full(40, 1.0)])[:, None]
    p = k.causal_filter(z, **k.TWO_STATES)
    assert p[30].argmax() == 0 and p[-1].argmax() == 1 and np.allclose(p.sum(axis=1), 1)


def brute_biweight(rows: list[tuple[float, float]]) -> float | None:
    """Tukey's biweight by the textbook loop."""
    rows = sorted((v, w) for v, w in rows if v is not None and w > 0)
    total = sum(w for _, w in rows)
    if len(rows) < 2:
        return None
    if len(rows) < 4:
        return sum(v * w for v, w in rows) / total
    run, centre = 0.0, None
    for v, w in rows:
        run += w / total
        if run >= 0.5 and centre is None:
            centre = v
    for _ in range(10):
        mad = float(np.median([abs(v - centre) for v, _ in rows]))
        if mad < 0.5:
            return centre
        u = [(v - centre) / (4.685 * mad) for v, _ in rows]
        e = [w / total * (1 - x * x) ** 2 if abs(x) < 1 else 0.0 for x, (_, w) in zip(u, rows, strict=True)]
        if sum(e) < 1e-10:
            return centre
        new = sum(x * v for x, (v, _) in zip(e, rows, strict=True)) / sum(e)
        centre, moved = new, abs(new - centre)
        if moved < 0.1:
            return centre
    return centre


def test_biweight_equals_brute_force(spark):
    r = np.random.default_rng(4)
    groups = {1: [(100.0, 1.0), (101.0, 1.0), (100.5, 1.0), (400.0, 1.0)], 2: [(1.0, 1.0), (3.0, 3.0)], 3: [(1.0, 1.0)], 4: [(None, 1.0), (5.0, 0.0)], 5: [(7.0, 1.0)] * 6}
    groups |= {10 + i: [(float(v), float(w)) for v, w in zip(r.normal(120, 25, 8), r.uniform(0.5, 2, 8), strict=True)] for i in range(20)}
    got = {x["py"]: x["ensemble"] for x in k.biweight(spark.createDataFrame([(g, v, w) for g, rows in groups.items() for v, w in rows], "py long, onset double, weight double")).collect()}
    assert set(got) == set(groups)
    for g, rows in groups.items():
        want = brute_biweight(rows)
        assert (got[g] is None) == (want is None) and (want is None or abs(got[g] - want) < 1e-9), g


def test_trend_filter_equals_the_covariance_form():
    r, q = np.random.default_rng(1), k.TrendNoise()
    y = np.cumsum(r.normal(0.3, 2.0, 300))
    x, p, move = np.array([y[0], 0.0]), np.eye(2) * q.first, np.array([[1.0, 1.0], [0.0, 1.0]])
    level, trend = k.local_trend(y)
    for t in range(300):
        x, p = move @ x, move @ p @ move.T + np.diag([q.level, q.trend])
        gap = y[t] - x[0]
        noise = max(q.floor, q.omega + q.alpha * gap**2)
        gain = p[:, 0] / (p[0, 0] + noise)
        x, p = x + gain * gap, p - np.outer(gain, p[0])
        assert abs(level[t] - x[0]) < 1e-8 and abs(trend[t] - x[1]) < 1e-8


def daily_rows(spark, n=400, seed=3):
    r, start = np.random.default_rng(seed), datetime.date(2001, 6, 22)
    return spark.createDataFrame([(2001, start + datetime.timedelta(days=i), i % 365, 0, float(r.normal(np.sin(i / 30), 0.3)), float(r.normal())) for i in range(n)], "py long, date date, dopy long, station long, x double, y double")


def test_hidden_states_equal_a_plain_forward_pass(spark):
    df = daily_rows(spark, 300)
    got = {r["date"]: (r["state"], r["p"]) for r in k.hidden_states(df, ["x"]).collect()}
    model = k.TWO_STATES
    p = [1.0, 0.0]
    for i, row in enumerate(sorted(df.collect(), key=lambda r: r["date"])):
        if i:
            p = [sum(p[a] * model["move"][a][b] for a in (0, 1)) for b in (0, 1)]
        var = 0.8 + 1e-6
        p = [p[s] * math.exp(-((row["x"] - model["means"][s][0]) ** 2) / (2 * var)) for s in (0, 1)]
        p = [v / sum(p) for v in p]
        assert got[row["date"]][0] == int(p[1] > p[0]) and abs(got[row["date"]][1] - max(p)) < 1e-9


def test_forecast_and_interaction_equal_least_squares(spark):
    df = daily_rows(spark, 200)
    rows = sorted(df.collect(), key=lambda r: r["date"])
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    terms = np.array([[*(x[t - i] for i in range(5)), *(y[t - i] for i in range(5)), 1.0] for t in range(4, 200)])
    beta = np.linalg.lstsq(terms[:-6], y[10:], rcond=None)[0]
    got = k.lagged_forecast(df, "x", "y").first()
    assert got["n"] == 190 and abs(got["forecast"] - terms[-1] @ beta) < 1e-8
    target = 1.5 * x - 0.5 * y + 2 * x * y + 3
    fit = k.interaction_fit(spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, target, strict=True)], "a double, b double, z double"), "a", "b", "z").first()
    assert np.allclose([fit["beta_a"], fit["beta_b"], fit["beta_ab"], fit["constant"], fit["r2"]], [1.5, -0.5, 2.0, 3.0, 1.0], atol=1e-7)


def test_spectrum_and_density_equal_plain_sums(spark):
    n = 240
    v = [math.sin(2 * math.pi * t / 24) + 0.5 * math.sin(2 * math.pi * t / 12) for t in range(n)]
    df = spark.createDataFrame([(0, t, v[t]) for t in range(n)], "station long, hour long, x double")
    peaks = {round(r["period"], 6): r["amplitude"] for r in k.spectrum(df, "x", top=3).collect()}
    for period in (24, 12):
        want = abs(sum(v[t] * complex(math.cos(2 * math.pi * t / period), -math.sin(2 * math.pi * t / period)) for t in range(n)))
        assert abs(peaks[float(period)] - want) < 1e-6
    # segments of 60 rows know the periods 30 and 20 next to 24
    assert min(k.density(df, "x").collect(), key=lambda r: r["rank"])["period"] in (20.0, 30.0)


def brute_persistent(x, days, level, lo, hi, sustain, least, up, eps):
    for i in range(1, len(x)):
        if not lo <= days[i] <= hi or x[i] is None or not (x[i] >= level if up else x[i] <= level):
            continue
        ahead = [v for v in x[i : i + sustain] if v is not None]
        if len(ahead) >= least - 2 and sum((v >= level - eps) if up else (v <= level + eps) for v in ahead) >= least:
            return days[i]
    return None


def centred(x, n):
    out = []
    for i in range(len(x)):
        own = [v for v in x[max(0, i - (n - 1 - (n - 1) // 2)) : i + (n - 1) // 2 + 1] if v is not None]
        out.append(sum(own) / len(own) if len(own) >= n // 2 else None)
    return out


def test_season_detectors_equal_plain_loops(spark):
    r, rows = np.random.default_rng(8), []
    for py in (2000, 2001, 2002):
        for i in range(365):
            swing = math.cos(2 * math.pi * (i - 190) / 365)
            value = lambda m, s, e: None if r.random() < 0.03 else float(m + s * swing + r.normal() * e)
            rows.append((py, datetime.date(py, 6, 22) + datetime.timedelta(days=i), i, value(0.1, 0.8, 0.3), value(70, 25, 6), value(44, 8, 2), value(220, -60, 15)))
    df = spark.createDataFrame(rows, "py long, date date, dopy long, u_comp double, cloud double, tcwv double, sw_rad double")
    two, three = m.SEASON_DETECTORS[0], m.SEASON_DETECTORS[2]
    got = {d.name: {x["py"]: x["onset"] for x in m.detected(df, d).collect()} for d in (two, three)}
    for py in (2000, 2001, 2002):
        own = [x for x in rows if x[0] == py]
        days = [x[2] for x in own]
        u, cloud, vapour, sun = (centred([x[k] for x in own], n) for k, n in ((3, 7), (4, 7), (5, 7), (6, 21)))
        joint = [None if None in z else float(z[0] > -0.30 and z[1] > 76.0 and z[2] > 45.0) for z in zip(u, cloud, vapour, strict=True)]
        share = []
        for i in range(365):
            back = [v for v in joint[max(0, i - 13) : i + 1] if v is not None]
            share.append(sum(back) / len(back) if len(back) >= 9 else None)
        assert got["B2_on"][py] == brute_persistent(share, days, 0.65, 100, 195, 10, 7, True, 0.025)
        dry = [v for v, d in zip(sun, days, strict=True) if 50 <= d <= 130 and v is not None]
        assert got["B3_on"][py] == brute_persistent(sun, days, float(np.percentile(dry, 15)), 100, 195, 14, 9, False, 0.025)


def test_season_table_takes_every_year(spark):
    """A year of few days gets its rows like any other."""
    names = sorted({r.field for d in m.SEASON_DETECTORS for r in d.rules})
    rows = [(py, datetime.date(py, 6, 22) + datetime.timedelta(days=i), i, *[float(i % 7)] * len(names)) for py, n in ((2000, 365), (2001, 40)) for i in range(n)]
    got = m.season_table(spark.createDataFrame(rows, "py long, date date, dopy long, " + ", ".join(f"{n} double" for n in names))).groupBy("py").count().collect()
    assert {r["py"]: r["count"] for r in got} == {2000: len(m.SEASON_DETECTORS), 2001: len(m.SEASON_DETECTORS)}


def test_welch_finds_a_sine():
    t = np.arange(2000)
    freq, p = k.welch(np.sin(2 * np.pi * t / 24), 240)
    assert 1 / freq[p.argmax()] == pytest.approx(24)


def test_lag_convention(spark):
    """A series that follows another three rows later peaks at +3."""
    r = np.random.default_rng(42)
    x = r.normal(size=400)
    y = np.roll(x, 3) + r.normal(0, 0.1, 400)
    df = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2000-01-01", periods=400).date, "x": x, "y": y}))
    rows = det.lag_correlation(df, "x", "y", 10, 50).collect()
    assert max(rows, key=lambda q: abs(q["r"]))["lag"] == 3


def test_rolling_frames_equal_pandas(spark):
    from pyspark.sql import Window

    from skyloom.functions import columns as c

    v = series(3, 60)
    df = frame(spark, {2000: v})
    x = pd.Series(v, dtype=float)
    w = Window.partitionBy("py").orderBy("date")
    for n in (5, 7, 14, 21, 30):
        got = [r[0] for r in df.select("date", c.rolling(F.avg, "v", c.centered(w, n), n // 2).alias("r")).orderBy("date").select("r").collect()]
        want = x.rolling(n, center=True, min_periods=n // 2).mean()
        assert np.allclose(np.array(got, float), want, equal_nan=True)


def test_lanczos_kernel_is_a_low_pass():
    w = np.array(det.lanczos_kernel(241, 1 / 90))
    assert len(w) == 241 and w.sum() == pytest.approx(1) and np.allclose(w, w[::-1])
    assert abs((w * np.cos(2 * np.pi * np.arange(-120, 121) / 10)).sum()) < 0.01


def test_cusum_of_residuals_equals_the_loop(spark):
    """Window, least rows, interpolation, regression on deviations, calm days, and the last zero, step by step."""
    import datetime
    import random

    r, rows = random.Random(12), []
    for py in range(2000, 2012):
        anchor = datetime.date(py, 6, 22)
        shift, gaps = (py - 1999) * 0.1, 0.55 if py == 2003 else 0.05
        level = 0.0
        for n in range(365):
            level = 0.6 * level + r.gauss(0, 0.2)
            if py == 2004 and 90 <= n <= 150:
                continue
            rows.append((py, anchor + datetime.timedelta(days=n), n, None if r.random() < gaps else level + (shift if n > 120 else 0.0) if py != 2005 else 1.0))
    expected = {}
    for py in range(2000, 2012):
        own = [(n, x) for p, _, n, x in rows if p == py and 60 <= n <= 200]
        expected[py] = None
        known = [i for i, (_, x) in enumerate(own) if x is not None]
        if len(own) < 90 or len(known) < 80:
            continue
        u = np.interp(np.arange(len(own)), known, [own[i][1] for i in known])
        d = u - u.mean()
        phi = max(-0.95, min(0.95, float((d[:-1] * d[1:]).sum() / ((d[:-1] ** 2).sum() + 1e-9))))
        e, days = d[1:] - phi * d[:-1], [n for n, _ in own[1:]]
        calm = [v for v, n in zip(e, days, strict=True) if n <= 100]
        if len(calm) < 15 or np.std(calm, ddof=1) < 1e-6:
            continue
        m, sd, total, zero = float(np.mean(calm)), float(np.std(calm, ddof=1)), 0.0, 0
        for i, v in enumerate(e):
            total = max(0.0, total + v - m - 0.5 * sd)
            zero = i if total < 1e-9 else zero
            if total > 5 * sd:
                expected[py] = days[zero]
                break
    got = {x["py"]: x["last_zero"] for x in det.cusum_prewhitened(spark.createDataFrame(rows, "py int, date date, dopy int, x double"), "x").collect()}
    assert got == expected
    assert sum(v is not None for v in expected.values()) >= 3 and expected[2003] is None and expected[2004] is None and expected[2005] is None


def test_interaction_fit_keeps_its_digits_around_large_means(spark):
    """Quarters of many orders: a and b vary by parts in a thousand around their means, and so does a * b. Against exact fractions."""
    r = np.random.default_rng(5)
    rows = [(151.0 + float(r.normal()) * 0.4, 38_000.0 + float(r.normal()) * 90, 180.0 + float(r.normal()) * 100) for _ in range(27)]
    x = [(Fraction(a), Fraction(b), Fraction(a) * Fraction(b), Fraction(1)) for a, b, _ in rows]
    system = [[sum(u[i] * u[j] for u in x) for j in range(4)] + [sum(u[i] * Fraction(y) for u, (_, _, y) in zip(x, rows, strict=True))] for i in range(4)]
    for i in range(4):
        for q in range(4):
            if q != i:
                f = system[q][i] / system[i][i]
                system[q] = [u - f * v for u, v in zip(system[q], system[i], strict=True)]
    want = [float(system[i][4] / system[i][i]) for i in range(4)]
    fit = k.interaction_fit(spark.createDataFrame(rows, "a double, b double, y double"), "a", "b", "y").first()
    assert [fit[n] for n in ("beta_a", "beta_b", "beta_ab", "constant")] == pytest.approx(want, rel=1e-6) and fit["n"] == 27 and 0 < fit["r2"] < 1
