"""Spacing by pointers, interval joins, climate context and the vector-phase detector, against plain loops written from their rules."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import climate, extremes, intervals, spacing, vector_phase

DAY = datetime.timedelta(days=1)
T0 = datetime.date(2015, 1, 1)


def anchor(year: int) -> datetime.date:
    return datetime.date(year, 6, 22)


def py_of(d: datetime.date) -> int:
    return d.year - (d < anchor(d.year))


# ---- greedy spacing


def greedy(numbers: list[int], least: int) -> list[int]:
    out = []
    for n in sorted(set(numbers)):
        if not out or n - out[-1] >= least:
            out.append(n)
    return out


def test_pointers_accept_what_a_scan_accepts(spark, monkeypatch):
    monkeypatch.setattr(spacing, "SUPER", 4)
    r = random.Random(1)
    places = {p: [r.randrange(1, 40 + 60 * p) for _ in range(5 + 17 * p)] for p in range(9)} | {9: [5], 10: list(range(1, 200)), 11: [1, 12, 13, 25, 10_000, 10_011, 10_012, 10**9], 12: [7] * 4}
    rows = [(p, n, f"{p}:{n}") for p, own in places.items() for n in own] + [(3, None, "null")]
    df = spark.createDataFrame(rows, "place int, rn long, note string").repartition(5)
    for least in (12, 1, 7):
        got = spacing.spaced(df, least, ("place",)).select("place", "rn").distinct().collect()
        assert sorted(map(tuple, got)) == sorted((p, n) for p, own in places.items() for n in greedy(own, least))
    assert spacing.spaced(df.where("place = 12"), 12, ("place",)).count() == 4
    assert sorted(x["rn"] for x in spacing.spaced(df.where("place = 11"), 12).collect()) == greedy(places[11], 12)
    assert spacing.spaced(df.limit(0), 12, ("place",)).count() == 0


def test_every_pointer_is_the_first_event_far_enough_on(spark, monkeypatch):
    monkeypatch.setattr(spacing, "SUPER", 3)
    r = random.Random(2)
    own = sorted({r.randrange(0, 900) for _ in range(150)} | {5_000, 5_030})
    got = {x["rn"]: x["to"] for x in spacing.pointers(spark.createDataFrame([(n,) for n in own], "rn long"), 12).collect()}
    assert got == {n: next((m for m in own if m >= n + 12), None) for n in own}


def test_onsets_of_a_rain_series(spark):
    r = random.Random(3)
    series = {k: [r.choice([0.0, 0.0, 0.0, 0.05, 0.7, 3.0]) if r.random() < 0.5 else 0.0 for _ in range(700)] for k in "ab"}
    rows = [(k, datetime.datetime(2020, 1, 1) + i * datetime.timedelta(hours=1), x) for k, xs in series.items() for i, x in enumerate(xs)]
    got = extremes.onsets(spark.createDataFrame(rows, "k string, time timestamp, p double"), "p", "time", ["k"]).select("k", "rn").collect()
    expected = []
    for k, xs in series.items():
        last = -(10**9)
        for i in range(6, len(xs) - 12):
            if xs[i] > 0.5 and all(x < 0.1 for x in xs[i - 6 : i]) and i - last >= 12:
                expected.append((k, i + 1))
                last = i
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 20


# ---- intervals


@pytest.mark.parametrize("width", [1, 7, 64])
def test_interval_join_gives_each_pair_once(spark, width):
    r = random.Random(width)
    span = lambda n, longest: [(i, T0 + (s := r.randrange(300)) * DAY, T0 + (s + r.randrange(longest)) * DAY) for i in range(n)]
    a, b = span(60, 40) + [(99, None, T0)], span(40, 90) + [(98, T0 + 5 * DAY, T0 + 4 * DAY)]
    got = intervals.overlapping(spark.createDataFrame(a, "i int, start date, stop date"), spark.createDataFrame(b, "j int, low date, high date"), width).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, s, e in a for j, lo, hi in b if s and lo <= hi and s <= hi and lo <= e)


# ---- climate context


def brute_context(years, sst, dmi, phases):
    out = {}
    for py in years:
        mean = lambda rows, months: (lambda v: sum(v) / len(v) if v else None)([x for d, x in rows if d.year == py and d.month in months])  # noqa: B023, E731
        s, m = mean(sst, (8, 9, 10)), mean(dmi, (9, 10, 11))
        enso = "ELNINO" if s is not None and s >= 0.5 else "LANINA" if s is not None and s <= -0.5 else "NETRAL"
        iod = "pIOD" if m is not None and m >= 0.4 else "nIOD" if m is not None and m <= -0.4 else "NETRAL"
        both = {("ELNINO", "pIOD"): "SINERGI", ("LANINA", "nIOD"): "SINERGI", ("ELNINO", "nIOD"): "COUNTER", ("LANINA", "pIOD"): "COUNTER"}.get((enso, iod), "NETRAL")
        low, high = anchor(py) + 100 * DAY, anchor(py) + 195 * DAY
        inside = [(p, a) for d, p, a in phases if low <= d <= high]
        runs, now = [], 0
        for p, a in [*inside, (0, 0)]:
            if p in (5, 6, 7, 8) and a >= 1.5:
                now += 1
            else:
                runs, now = [*runs, now], 0
        events = [x for x in runs if x >= 5]
        lead = any(p in (5, 6, 7, 8) and a >= 1.5 for d, p, a in phases if low - 15 * DAY <= d <= low - 7 * DAY)
        odds = min(0.95, 0.5 + 0.15 * lead + (0.10 if len(events) >= 2 else 0.05 if events else 0.0))
        out[py] = (s, m, enso, iod, both, sum(runs), len(events), max(events, default=0), max((a for _, a in inside), default=None), lead, odds)
    return out


@pytest.fixture(scope="module")
def indices():
    r = random.Random(5)
    phases, phase, amp = [], 1, 1.0
    for n in range(2500):
        phase = phase % 8 + 1 if r.random() < 0.12 else phase
        amp = max(0.0, amp + r.gauss(0, 0.25) + 0.1 * (1.6 - amp))
        if r.random() > 0.04:  # missing days do not end a run
            phases.append((T0 + n * DAY, phase, amp))
    sst = [(T0 + n * DAY, 1.2 * math.sin(n / 300) + r.gauss(0, 0.2)) for n in range(0, 2000, 3)]
    dmi = [(datetime.date(y, m, 1), r.choice([-0.8, -0.1, 0.2, 0.9])) for y in range(2015, 2021) for m in range(1, 13)]
    return phases, sst, dmi


def context_of(spark, indices, years):
    phases, sst, dmi = indices
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    s = frame(sst, "date date, value double")
    return climate.context(frame([(y,) for y in years], "py long"), s, s.withColumn("value", -F.col("value")), frame(dmi, "month date, value double"), frame(phases, "date date, phase int, amplitude double").repartition(4))


def test_context_equals_plain_loops(spark, indices):
    years = range(2014, 2024)
    phases, sst, dmi = indices
    expected = brute_context(years, sst, dmi, phases)
    names = ("sst_aso", "dmi_son", "enso", "iod", "interaction", "active_days", "n_events", "max_run", "peak_amp", "lead_flag", "odds")
    got = {r["py"]: tuple(r[n] for n in names) for r in context_of(spark, indices, years).collect()}
    assert set(got) == set(expected)
    for py, row in expected.items():
        assert all(x == pytest.approx(y, rel=1e-9) if isinstance(y, float) else x == y for x, y in zip(got[py], row, strict=True)), (py, got[py], row)
    assert sum(e[6] for e in expected.values()) >= 3 and any(e[9] for e in expected.values()) and any(e[4] != "NETRAL" for e in expected.values())


def test_flags(spark):
    ctx = [(1, 1.0, -0.9, "COUNTER", False), (2, 1.0, 0.9, "SINERGI", True), (3, 0.5, -0.9, "COUNTER", False), (4, None, None, "NETRAL", True), (5, 0.0, 0.0, "NETRAL", False), (6, 1.0, -1.0, "COUNTER", True)]
    seasons = [(1, 200.0, 100.0), (2, 120.0, 100.0), (3, 200.0, 100.0), (4, 121.0, 99.0), (5, 119.0, 101.0), (6, None, 300.0), *[(10 + i, 120.0, 100.0) for i in range(8)]]
    got = climate.flags(spark.createDataFrame(ctx, "py int, sst_aso double, dmi_son double, interaction string, lead_flag boolean"), spark.createDataFrame(seasons, "py int, onset double, duration double"))
    assert {r["py"]: r["flags"] for r in got.collect()} == {1: "onset-anomaly", 2: "synergy lead", 3: "-", 4: "lead", 5: "-", 6: "duration-anomaly lead"}


def test_weekly_index_before_the_monthly_one(spark):
    weekly, monthly = (spark.createDataFrame([(datetime.date(2020, 9, 1), v)], "month date, value double") for v in (1.0, 2.0))
    assert [r["value"] for r in climate.first_source(weekly, monthly).collect()] == [1.0]
    assert [r["value"] for r in climate.first_source(weekly.limit(0), monthly).collect()] == [2.0]


# ---- vector phase


def brute_low(values: list, taps: int, cutoff: float) -> np.ndarray:
    x, known = np.array([np.nan if v is None else v for v in values]), [i for i, v in enumerate(values) if v is not None]
    x = np.interp(np.arange(len(x)), known, x[known])
    half = taps // 2
    n = np.arange(-half, half + 1, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        ideal, sigma = np.sin(2 * np.pi / cutoff * n) / (np.pi * n), np.sin(np.pi * n / half) / (np.pi * n / half)
    ideal[half], sigma[half] = 2 / cutoff, 1.0
    w = ideal * sigma
    return np.convolve(x, w / w.sum(), mode="full")[half : half + len(x)]


def brute_onset(dates, low, active):
    out = {}
    for py in sorted({py_of(d) for d in dates}):
        i = [k for k, d in enumerate(dates) if py_of(d) == py]
        u, dopy = [low[k] for k in i], [(dates[k] - anchor(py)).days % 365 for k in i]
        dry, wet = [a for a, n in zip(u, dopy, strict=True) if 60 <= n <= 120], [a for a, n in zip(u, dopy, strict=True) if 180 <= n <= 280]
        out[py] = None
        if len(i) < 60 or len(dry) < 10 or len(wet) < 10 or max(wet) - min(dry) < 0.05:
            continue
        threshold = 0.02 if max(wet) - min(dry) < 0.15 else min(dry) + 0.2 * (max(wet) - min(dry))
        out[py] = next((dopy[k] for k in range(1, len(i) - 1) if 60 <= dopy[k] <= 200 and u[k - 1] < threshold <= u[k] and dates[i[k]] not in active), None)
    return out


@pytest.fixture(scope="module")
def winds(spark):
    r, rows = random.Random(6), []
    for place, size in ((0, 1.0), (1, 0.12), (2, 0.01), (3, 0.6)):
        for n in range(1500):
            if r.random() < 0.02:
                continue
            d = T0 + n * DAY
            u = size * math.cos(2 * math.pi * ((d - anchor(py_of(d))).days - 190) / 365) * (1 + 0.3 * math.sin(n / 20)) + r.gauss(0, 0.3 * size)
            rows.append((place, d, u if r.random() > 0.08 else None, size * math.sin(n / 90) + r.gauss(0, 0.1)))
    return rows, spark.createDataFrame(rows, "place int, date date, u double, v double").repartition(4).cache()


def test_low_pass_and_direction(spark, winds):
    rows, df = winds
    got = vector_phase.with_direction(vector_phase.low_passed(df, ("u", "v"), "place"), "low_u", "low_v", "place").collect()
    for place in (0, 3):
        own = sorted(x for x in rows if x[0] == place)
        mine = sorted((x["date"], x["low_u"], x["low_v"], x["direction"], x["turned"]) for x in got if x["place"] == place)
        u, v = (brute_low([x[k] for x in own], 241, 80.0) for k in (2, 3))
        assert [m[0] for m in mine] == [x[1] for x in own]
        assert np.allclose([m[1] for m in mine], u, atol=1e-12) and np.allclose([m[2] for m in mine], v, atol=1e-12)
        angle = (np.degrees(np.arctan2(u, v)) + 180) % 360
        assert np.allclose([m[3] for m in mine], angle, atol=1e-6) and np.allclose([m[4] for m in mine], np.unwrap(angle, period=360), atol=1e-6)


def test_onset_behind_the_gate(spark, winds):
    rows, df = winds
    low = vector_phase.low_passed(df, ("u",), "place")
    none = {p: brute_onset([x[1] for x in own], brute_low([x[2] for x in own], 241, 80.0), set()) for p in range(4) if (own := sorted(x for x in rows if x[0] == p))}
    # the days on which place 0 crosses are active, and some others
    crossed = [anchor(py) + n * DAY for py, n in none[0].items() if n is not None]
    assert crossed and any(n is not None for n in none[1].values()) and set(none[2].values()) == {None}
    active = set(crossed[:2]) | {T0 + n * DAY for n in range(0, 1500, 50)}
    phases = spark.createDataFrame([(T0 + n * DAY, 2.0 if T0 + n * DAY in active else 1.9) for n in range(1500)], "date date, amplitude double")
    got = {(r["place"], r["py"]): (r["onset"], r["gated"]) for r in vector_phase.onsets(low, phases, "low_u", "place").collect()}
    expected = {(p, py): n for p in range(4) if (own := sorted(x for x in rows if x[0] == p)) for py, n in brute_onset([x[1] for x in own], brute_low([x[2] for x in own], 241, 80.0), active).items()}
    assert {k: n for k, (n, _) in got.items()} == expected
    assert sum(g for _, g in got.values()) >= 2
