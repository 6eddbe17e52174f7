"""The station data source and the loads, against plain loops over the same files."""

import math
from collections import defaultdict
from pathlib import Path

import pytest

from skyloom.sources import stations
from skyloom.sources.stations import SIX_HOURS, Source

HEAD = "latitude,longitude,elevation,utc_offset_seconds\n-7.5,110.2,320,25200\n\n"
NAMES = ("time", "temperature_2m (°C)", "cloud_cover_low (%)", "cloud_cover (%)", "sunshine_duration (s)", "shortwave_radiation (W/m²)", "vapour_pressure_deficit (kPa)", "soil_moisture_0_to_7cm (m³/m³)", "wind_speed_10m (km/h)", "wind_direction_10m (°)")


def lines(day0: int, days: int, step_hours: int, seed: int, gaps: tuple = (), names=NAMES):
    """Rows of a file as lists of text cells."""
    out = []
    for d in range(day0, day0 + days):
        for h in range(0, 24, step_hours):
            if (d, h) in gaps:
                continue
            x = (d * 24 + h) * 7919 + seed * 104729
            cells = [f"2024-01-{d:02d}T{h:02d}:00", f"{20 + x % 13}.5", f"{x % 50}", f"{x % 101}", f"{x % 3600}", f"{x % 900}", f"{(x % 17) / 10}", f"0.{x % 89 + 10}", f"{x % 31}", f"{x % 360}"]
            if x % 11 == 0:
                cells[3] = "NaN"
            if x % 13 == 0:
                cells[1] = "bad"
            out.append(cells)
    return out


def written(path, rows, cut=()):
    """A file with a preamble; rows named in `cut` lose their last cells."""
    text = HEAD + ",".join(NAMES) + "\n" + "".join(",".join(r[: len(r) - 3] if i in cut else r) + "\n" for i, r in enumerate(rows))
    path.write_text(text, encoding="utf-8")
    return [r[: len(r) - 3] if i in cut else r for i, r in enumerate(rows)]


def number(cells, name):
    i = NAMES.index(next(n for n in NAMES if n.startswith(name)))
    try:
        v = float(cells[i])
        return None if math.isnan(v) else v
    except (IndexError, ValueError):
        return None


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def brute_days(rows, seconds):
    by_day = defaultdict(list)
    for r in rows:
        by_day[r[0][:10]].append(r)
    out = {}
    for day, own in by_day.items():
        hours = range(12, 18) if seconds == 3600 else (12, 18)
        temp = [t for r in own if (t := number(r, "temperature_2m")) is not None]
        out[day] = {
            "dtr": max(temp) - min(temp) if temp else None, "cloud_mean": mean(number(r, "cloud_cover (") for r in own), "cloud_aft": mean(number(r, "cloud_cover (") for r in own if int(r[0][11:13]) in hours),
            "sunshine_h": sum(number(r, "sunshine") or 0 for r in own) / 3600, "sw_rad_MJ": sum(number(r, "shortwave") or 0 for r in own) * seconds / 1e6, "vpd": mean(number(r, "vapour") for r in own), "sm_sh": mean(number(r, "soil_moisture_0") for r in own), "tcwv": None,
        }
    return out


def brute_merge(one, two):
    out = {}
    for day in one.keys() | two.keys():
        a, b = one.get(day, {}), two.get(day, {})
        row = {}
        for name in ("dtr", "cloud_mean", "cloud_aft", "sunshine_h", "sw_rad_MJ", "vpd", "sm_sh", "tcwv"):
            w = (0.4996, 0.5004) if name.startswith("sm") else (0.4154, 0.5846)
            x, y = a.get(name), b.get(name)
            row[name] = w[0] * x + w[1] * y if x is not None and y is not None else (y if x is None else x)
        out[day] = row
    return out


@pytest.fixture()
def files(tmp_path):
    """P1: two hourly files that share a day, with gaps, and a six-hourly one; P2: six-hourly only, ragged."""
    a = written(tmp_path / "p1_a.csv", lines(1, 4, 1, 1, gaps=((2, 13), (3, 0))))
    b = written(tmp_path / "p1_b.csv", lines(4, 3, 1, 2))
    six = written(tmp_path / "p1_six.csv", lines(1, 12, 6, 3))
    two = written(tmp_path / "p2_six.csv", lines(2, 8, 6, 4), cut=(3, 7, 8))
    sources = [Source("P1", str(tmp_path / "p1_a.csv")), Source("P1", str(tmp_path / "missing.csv")), Source("P1", str(tmp_path / "p1_b.csv")), Source("P1", str(tmp_path / "p1_six.csv"), SIX_HOURS), Source("P2", str(tmp_path / "none.csv")), Source("P2", str(tmp_path / "p2_six.csv"), SIX_HOURS)]
    return sources, a, b, six, two


def same(got, expected):
    assert set(got) == set(expected)
    for day, row in expected.items():
        for name, x in row.items():
            assert (got[day][name] is None) == (x is None) and (x is None or abs(got[day][name] - x) < 1e-9), (day, name, got[day][name], x)


def loaded(df):
    return {str(r["date"]): r.asDict() for r in df.collect()}


def test_hourly_before_six_hourly_by_station(spark, files):
    sources, a, b, six, two = files
    first = brute_days(b, 3600) | brute_days(a, 3600)  # the day that both files hold comes from the first
    same(loaded(stations.daily_load(stations.station_rows(spark, sources))), brute_merge(first, brute_days(two, SIX_HOURS)))


def test_hourly_before_six_hourly_by_day(spark, files):
    sources, a, b, six, two = files
    first = brute_days(six, SIX_HOURS) | brute_days(b, 3600) | brute_days(a, 3600)
    same(loaded(stations.daily_load(stations.station_rows(spark, sources), by="day")), brute_merge(first, brute_days(two, SIX_HOURS)))


@pytest.mark.parametrize("size", [1, 57, 64, 1000, 1 << 20])
def test_ranges_hold_every_line_once(spark, files, size):
    sources, a, *_ = files
    if size == 1:
        a = written(Path(sources[0].path), a[:5])
    got = stations.station_rows(spark, sources[:1], size).select("time", "temp2m", "cloud", "wd10", "rank", "tcwv")
    expected = sorted((r[0].replace("T", " ") + ":00", number(r, "temperature"), number(r, "cloud_cover ("), number(r, "wind_direction"), 0, None) for r in a)
    assert sorted((str(t), *rest) for t, *rest in got.collect()) == expected
    assert got.rdd.getNumPartitions() > 1 or size >= 1 << 20


def test_hourly_load_merges_and_adds_features(spark, files, tmp_path):
    sources, a, b, _, _ = files
    other = written(tmp_path / "p2.csv", lines(3, 5, 1, 9))
    got = {str(r["time"]): r for r in stations.hourly_load(stations.station_rows(spark, [*sources[:3], Source("P2", str(tmp_path / "p2.csv"))])).collect()}
    one, two = {r[0].replace("T", " ") + ":00": r for r in b + a}, {r[0].replace("T", " ") + ":00": r for r in other}
    assert set(got) == one.keys() | two.keys()
    for t, r in got.items():
        x, y = (number(s[t], "wind_direction") if t in s else None for s in (one, two))
        parts = [(w, math.radians(v)) for w, v in ((0.4154, x), (0.5846, y)) if v is not None]
        turn = math.degrees(math.atan2(sum(w * math.sin(v) for w, v in parts), sum(w * math.cos(v) for w, v in parts))) % 360
        assert abs((r["wd10"] - turn + 180) % 360 - 180) < 1e-9
        assert r["hour"] == int(t[11:13]) and r["month"] == 1 and r["mangsa"] == 6 and abs(r["u"] + math.sin(math.radians(turn))) < 1e-9


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "no_header.csv").write_text("a,b\n1,2\n")
    (tmp_path / "last.csv").write_text("time,cloud_cover_low (%),rh\n2024-01-01,5,1\nnot a time,5,1\n2024-01-02 06:00:30,1e1,,9,9\n2024-01-03,7")
    got = stations.station_rows(spark, [Source("x", str(tmp_path))])
    assert sorted((str(r["time"]), r["cloud_lo"], r["cloud"]) for r in got.collect()) == [("2024-01-01 00:00:00", 5.0, None), ("2024-01-02 06:00:30", 10.0, None), ("2024-01-03 00:00:00", 7.0, None)]
    assert stations.daily_load(stations.station_rows(spark, [Source("x", str(tmp_path / "nowhere.csv"))])).count() == 0
