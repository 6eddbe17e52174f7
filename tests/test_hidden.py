"""Seasons by hidden states and the streaming filter, against plain loops."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import hidden
from skyloom.plans import catalog, seasons
from skyloom.streaming import states

DIR = "/root/testdata/sf0.001"
DAY = datetime.timedelta(days=1)


def day(n: int) -> datetime.date:
    return datetime.date(2015, 1, 1) + n * DAY


def anchor(year: int) -> datetime.date:
    return datetime.date(year, 6, 22)


def py_of(d: datetime.date) -> int:
    return d.year - (d < anchor(d.year))


def synthetic(places: int, days: int) -> pd.DataFrame:
    r, out = random.Random(4), []
    for place in range(places):
        for n in range(days):
            if r.random() < 0.03 * place:
                continue
            d = day(n)
            swing = math.cos(2 * math.pi * ((d - anchor(py_of(d))).days - 185 - 12 * place) / 365)
            out.append((place, d, max(0.0, 6 + 5 * swing + r.gauss(0, 3)), 44 + 8 * swing + r.gauss(0, 2) if r.random() > 0.1 else None, 72 + 24 * swing + r.gauss(0, 4), 0.1 + 0.7 * swing + r.gauss(0, 0.2)))
    return pd.DataFrame(out, columns=["place", "date", "precip", "tcwv", "cloud", "u_comp"])


@pytest.fixture(scope="module")
def table(spark):
    df = synthetic(3, 1700)
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(rows, "place long, date date, precip double, tcwv double, cloud double, u_comp double").repartition(5).cache(), df


def brute_features(df: pd.DataFrame) -> dict:
    """(place, date) -> four features, by looping over rows."""
    out = {}
    for place, g in df.groupby("place"):
        rows, filled = g.sort_values("date").to_dict("records"), {"tcwv": [], "cloud": []}
        for r in rows:
            for f, seen in filled.items():
                seen.append(r[f] if not math.isnan(r[f]) else (seen[-1] if seen else math.nan))
        for i, r in enumerate(rows):
            window = range(max(0, i - 29), i + 1)
            sums = [[rows[k]["precip"] for k in window], [filled["tcwv"][k] for k in window], [filled["cloud"][k] for k in window], [rows[k]["u_comp"] for k in window]]
            sums = [[x for x in v if not math.isnan(x)] for v in sums]
            if all(len(v) >= 15 for v in sums):
                out[place, r["date"]] = [sum(sums[0])] + [sum(v) / len(v) for v in sums[1:]]
    return out


def brute_filter(x: list, start: list, model: hidden.Model) -> list:
    """The forward recursion, state by state."""
    out, k = [], len(start)
    for t, row in enumerate(x):
        z = [(v - m) / s for v, m, s in zip(row, model.centre, model.scale, strict=True)]
        logs = []
        for mean, cov in zip(model.means, model.covs, strict=True):
            a = np.array(cov) + 1e-6 * np.eye(len(mean))
            d = np.array(z) - np.array(mean)
            logs.append(-0.5 * (d @ np.linalg.solve(a, d) + math.log(np.linalg.det(a)) + len(z) * math.log(2 * math.pi)))
        before = start if t == 0 else [sum(out[-1][i] * model.move[i][j] for i in range(k)) for j in range(k)]
        w = [b * math.exp(v - max(logs)) for b, v in zip(before, logs, strict=True)]
        out.append([v / sum(w) for v in w] if sum(w) > 0 else before)
    return out


def brute_season(features: dict, model: hidden.Model) -> dict:
    """(place, py) -> onset, offset, year by year."""
    out = {}
    for place in {p for p, _ in features}:
        for py in {py_of(d) for p, d in features if p == place} | {py_of(d) + 1 for p, d in features if p == place}:
            first = anchor(py)
            own = sorted(d for p, d in features if p == place and first <= d < first + 365 * DAY)
            warm = sorted(d for p, d in features if p == place and first - 180 * DAY <= d < first)
            start = [s + 1e-12 for s in model.start]
            if len(own) + len(warm) < 60:
                continue
            if len(warm) < 90:
                warm, start = [], [1.0 + 1e-12, 1e-12, 1e-12, 1e-12]
                if len(own) < 60:
                    continue
            if len(own) < 30:
                continue
            start = [s / sum(start) for s in start]
            p = brute_filter([features[place, d] for d in warm + own], start, model)[len(warm) :]
            days = [(d - first).days for d in own]
            early = [(n, q) for n, q in zip(days, p, strict=True) if 100 <= n <= 195]
            i1, i2 = (next((n for n, q in early if q[s] >= 0.70), None) for s in (1, 2))
            onset = i1 + 25.0 if i1 is not None else (max(100.0, i2 - 40.0) if i2 is not None else None)
            late = [(n, q[3]) for n, q in zip(days, p, strict=True) if 170 <= n <= 330]
            offset = next((n for i, (n, q) in enumerate(late) if q >= 0.60 and sum(v >= 0.60 * 0.85 for _, v in late[i : i + 7]) >= 5), None)
            if offset is None and late and max(q for _, q in late) >= 0.60 * 0.8:
                offset = max(late, key=lambda x: (x[1], -x[0]))[0]
            out[place, py] = (onset, None if offset is None else float(offset))
    return out


def test_seasons_equal_plain_loops(spark, table):
    rows, df = table
    features = hidden.rolled(rows, hidden.FOUR)
    expected = brute_features(df)
    got = {(r["place"], r["date"]): [r[n] for n in seasons.NAMES] for r in features.collect()}
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
    model = seasons.place_model(features)
    assert len(model.means) == 4 and all(abs(sum(m) - 1) < 1e-9 for m in model.move)
    found = {(r["place"], r["py"]): (r["onset"], r["offset"]) for r in hidden.seasons(hidden.posteriors(features, model)).collect()}
    brute = brute_season(expected, model)
    assert found == brute
    assert sum(a is not None for a, _ in brute.values()) >= 6 and sum(b is not None for _, b in brute.values()) >= 6


def test_rules_of_onset_and_offset(spark):
    """First state, wet state at once, a short flicker, the likeliest day, and years without either."""
    one = lambda *p: list(p)
    calm = one(0.9, 0.05, 0.05, 0.0)
    cases = {
        1: {120: one(0.1, 0.8, 0.1, 0.0)}, 2: {110: one(0.0, 0.1, 0.9, 0.0)}, 3: {n: one(0.1, 0.1, 0.1, 0.7) for n in range(200, 220)}, 4: {200: one(0.1, 0.1, 0.1, 0.7), 250: one(0.0, 0.0, 0.25, 0.75)}, 5: {},
        6: {90: one(0.0, 1.0, 0.0, 0.0), 150: one(0.0, 0.0, 0.9, 0.1)},
    }
    rows = [(place, 2016, anchor(2016) + n * DAY, n, special.get(n, calm)) for place, special in cases.items() for n in range(365)]
    got = {r["place"]: (r["onset"], r["offset"]) for r in hidden.seasons(spark.createDataFrame(rows, "place long, py long, date date, dopy long, p array<double>")).collect()}
    assert got == {1: (145.0, None), 2: (100.0, None), 3: (None, 200.0), 4: (None, 250.0), 5: (None, None), 6: (110.0, None)}


def test_years_of_too_few_rows_have_no_season(spark, table):
    rows, _ = table
    few = hidden.rolled(rows.where("place = 0 and date < date'2015-07-30'"), hidden.FOUR)
    model = seasons.place_model(hidden.rolled(rows, hidden.FOUR))
    assert {r["py"] for r in hidden.posteriors(few, model).collect()} == {2014, 2015} and hidden.posteriors(few.limit(20), model).count() == 0


def test_query_runs(spark):
    found = catalog.queries()["hidden_season"](spark, DIR)
    assert found.columns == ["place", "py", "onset", "offset", "duration"] and found.count() > 0


MODEL = hidden.Model(
    ("a", "b"), (1.0, 2.0), (2.0, 0.5), (0.2, 0.8, 0.0), ((0.9, 0.1, 0.0), (0.05, 0.9, 0.05), (0.1, 0.0, 0.9)), ((-1.0, 0.0), (0.5, 0.5), (1.5, -0.5)), (((1.0, 0.2), (0.2, 1.0)), ((0.5, 0.0), (0.0, 0.5)), ((1.0, -0.3), (-0.3, 0.8)))
)


def rows_of(place: str, n: int, seed: int, gap_at: int | None = None) -> list:
    r = random.Random(seed)
    t0 = datetime.datetime(2020, 1, 1)
    return [(place, t0 + datetime.timedelta(days=i + (100 if gap_at is not None and i >= gap_at else 0)), r.gauss(1, 2), r.gauss(2, 0.5)) for i in range(n)]


def streamed(spark, folder, batches, **options):
    """Results after each batch file has gone through the stream in its own micro-batch."""
    schema = "place string, ts timestamp, a double, b double"
    out = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(folder / "all" / f"b{i}"))
    for i in range(len(batches)):
        for f in sorted((folder / "all" / f"b{i}").glob("*.parquet")):
            (folder / "in").mkdir(exist_ok=True)
            f.rename(folder / "in" / f"{i:03d}.parquet")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        q = states.hidden_state_stream(stream, MODEL, **options).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    for r in spark.read.parquet(str(folder / "out")).collect():
        out.append((r["place"], r["ts"], r["p"]))
    return out


def test_shuffled_and_late_rows_give_the_batch_result(spark, tmp_path):
    every = rows_of("x", 40, 1) + rows_of("y", 30, 2)
    r = random.Random(7)
    # rows arrive up to eight days out of order, over several batches
    arriving = sorted(every, key=lambda row: (row[1] + datetime.timedelta(days=r.uniform(0, 8)), row[0]))
    flush = [("z", datetime.datetime(2021, 1, 1), 0.0, 0.0)]
    got = streamed(spark, tmp_path, [arriving[:25], arriving[25:45], arriving[45:], flush, flush], late="12 days", idle_days=1000)
    for place in "xy":
        own = sorted(row[1:] for row in every if row[0] == place)
        expected = brute_filter([row[1:] for row in own], states.first_state(MODEL).tolist(), MODEL)
        mine = sorted((ts, p) for name, ts, p in got if name == place)
        assert [ts for ts, _ in mine] == [row[0] for row in own]
        assert np.allclose([p for _, p in mine], expected, rtol=1e-9, atol=1e-12)


def test_too_late_rows_are_dropped_and_idle_places_forgotten(spark, tmp_path):
    every = rows_of("x", 30, 3, gap_at=15)
    flush = [("z", datetime.datetime(2022, 1, 1), 0.0, 0.0)]
    late = [("x", datetime.datetime(2020, 1, 3, 5), 9.0, 9.0)]
    got = streamed(spark, tmp_path, [every[:10], every[10:20], late + every[20:], flush, flush], late="1 days", idle_days=50)
    mine = sorted((ts, p) for name, ts, p in got if name == "x")
    assert [ts for ts, _ in mine] == [row[1] for row in every]
    start = states.first_state(MODEL).tolist()
    expected = brute_filter([r[2:] for r in every[:15]], start, MODEL) + brute_filter([r[2:] for r in every[15:]], start, MODEL)
    assert np.allclose([p for _, p in mine], expected, rtol=1e-9, atol=1e-12)
