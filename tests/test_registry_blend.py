"""Blending by registry: published weights, plain loops, and the edges of the estimates."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import registry_blend as rb

#: Weights of the first station and alphas known for a power, all with a terrain-fitted first cell. Fixed values.
KNOWN = {"vpd": (0.4419, 0.9759, 0.8229), "tcwv": (0.4374, 1.0328, 0.9071), "cloud": (0.4378, 0.7243, 0.9071), "sunshine": (0.4344, 1.3564, 0.8556), "sm_0_7": (0.4495, 1.4543, 0.6772), "sm_28_100": (0.4507, 0.6183, 0.7711)}


def pair(spark, target=(-7.521951, 112.566089, 10.0), one=(-7.486819, 112.538210, 10.0), two=(-7.5571175, 112.557350, 10.0)):
    return spark.createDataFrame([(1, *one, *two, *target, "terrain", "nearest")], "pair int, s1_lat double, s1_lon double, s1_alt double, s2_lat double, s2_lon double, s2_alt double, t_lat double, t_lon double, t_alt double, s1_cell string, s2_cell string")


def test_geometry_and_weights_as_published(spark):
    g = rb.geometry(pair(spark)).first()
    assert [round(g[n], 4) for n in ("d1", "d2", "d12", "along", "across")] == pytest.approx([4.9706, 4.0273, 8.0966, 0.5647, 1.9491], abs=2e-4)
    # a registry whose default powers are the published ones, on too few rows to estimate them
    variables = tuple(rb.Variable(v.field, v.kind, v.lapse, v.quality, KNOWN[v.field][1], v.range_km) for v in rb.REGISTRY if v.field in KNOWN)
    values = spark.createDataFrame([(1, datetime.datetime(2020, 1, 1), f, 1.0, 2.0) for f in KNOWN], "pair int, time timestamp, field string, v1 double, v2 double")
    got = {r["field"]: (r["w1"], r["power"], r["alpha"]) for r in rb.weights(values, pair(spark), tuple(KNOWN), variables).collect()}
    for f, known in KNOWN.items():
        assert got[f] == pytest.approx(known, abs=1.5e-4), f


def test_distance_counts_height_and_lines_are_clamped(spark):
    p = (0.0, 100.0)
    flat = rb.geometry(pair(spark, (*p, 0.0), (0.0, 100.1, 0.0), (0.0, 100.2, 0.0))).first()
    assert flat["along"] == 0.0 and flat["across"] == pytest.approx(0.0, abs=1e-9)
    high = rb.geometry(pair(spark, (*p, 2000.0), (0.0, 100.1, 0.0), (0.0, 100.2, 0.0))).first()
    assert high["d1"] == pytest.approx(math.hypot(flat["d1"], 10.0)) and high["dz1"] == 2000.0
    same = rb.geometry(pair(spark, (*p, 0.0), (0.5, 100.0, 0.0), (0.5, 100.0, 0.0))).first()
    assert (same["along"], same["across"]) == (0.5, 0.0)


def test_power_of_the_variogram(spark):
    cases = [(47, 1.0, 1.0, 1.0), (48, 1.0, 1.0, 1.0), (100, 0.2, 1.0, 1.0), (100, 1e-3, 5.0, 5.0), (100, 4.0, 1.0, 1.0), (100, 0.0, 1.0, 1.0), (100, 1.0, 0.0, 0.0), (100, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(cases)], "i int, n long, d double, a double, b double")
    for far, reach in ((8.0, 40.0), (90.0, 40.0), (1e-9, 40.0), (8.0, 0.0)):
        got = {r["i"]: r["p"] for r in df.select("i", rb.variogram_power(F.col("n"), F.col("d"), F.col("a"), F.col("b"), F.lit(far), F.lit(reach), F.lit(2.0)).alias("p")).collect()}
        for i, (n, d, a, b) in enumerate(cases):
            gamma, sill = (0.5 * d, 0.5 * (a + b)) if d is not None else (0.0, 0.0)
            expected = 2.0
            if n >= 48 and sill >= 1e-12 and gamma >= 1e-12:
                expected = min(3.0, max(0.5, math.log(min(gamma / sill, 0.999)) / math.log(max(1e-3, min(far / max(reach, 0.1), 0.999))) / 2))
            assert got[i] == pytest.approx(expected), (far, reach, i)


def test_spec_by_name_and_beginning():
    assert rb.spec_of("cloud").range_km == 80.0 and rb.spec_of("cloud_lo").range_km == 60.0
    assert rb.spec_of("wd10_max").kind == "circular" and rb.spec_of("wd10_max").field == "wd10_max"
    assert rb.spec_of("unheard_of") == rb.Variable("unheard_of")


def test_blend_of_every_kind(spark):
    """Two stations at heights of their own, gaps, a missing hour, and all four kinds, against loops."""
    r, t0 = random.Random(9), datetime.datetime(2021, 3, 1)
    fields = ("temp2m", "pressure", "wd10", "wcode", "ws10")
    rows = []
    for station in (1, 2):
        for h in range(80):
            if (station, h) == (2, 5):
                continue
            base = [25 + r.gauss(0, 2), 1000 + r.gauss(0, 3), r.uniform(0, 360), float(r.randrange(4)), r.uniform(0, 20)]
            rows.append((1, station, t0 + datetime.timedelta(hours=h), *[None if r.random() < 0.1 else x for x in base]))
    df = spark.createDataFrame(rows, "pair int, station int, time timestamp, temp2m double, pressure double, wd10 double, wcode double, ws10 double").repartition(3)
    points = pair(spark, (-7.52, 112.56, 300.0), (-7.48, 112.53, 100.0), (-7.55, 112.55, 900.0))
    values = rb.pair_values(df, points, fields)
    w = {x["field"]: x for x in rb.weights(values, points, fields).collect()}
    kelvin = {s: 273.15 + sum(t) / len(t) for s in (1, 2) if (t := [x[3] for x in rows if x[1] == s and x[3] is not None])}
    table = {(x[1], x[2], f): x[3 + i] for x in rows for i, f in enumerate(fields)}

    def corrected(station, time, f):
        x, dz = table[station, time, f], 200.0 if station == 1 else -600.0
        if x is None:
            return None
        return x - 6.5e-3 * dz if f == "temp2m" else x * (1 - 9.80665 * dz / (287.053 * kelvin[station])) if f == "pressure" else x

    got = {(x["time"], x["field"]): (x["value"], x["sigma"]) for x in rb.blended(values, rb.weights(values, points, fields)).collect()}
    times = {x[2] for x in rows if x[1] == 1} & {x[2] for x in rows if x[1] == 2}
    assert set(got) == {(t, f) for t in times for f in fields}
    for (t, f), (value, sigma) in got.items():
        a, b = (corrected(s, t, f) for s in (1, 2))
        w1, w2 = w[f]["w1"], w[f]["w2"]
        if f == "wcode":
            assert (value, sigma) == (a if w1 >= w2 else b, None)
        elif a is None or b is None:
            assert (value, sigma) == (None, None)
        elif f == "wd10":
            y, x = (w1 * g(math.radians(a)) + w2 * g(math.radians(b)) for g in (math.sin, math.cos))
            assert value == pytest.approx(math.degrees(math.atan2(y, x)) % 360) and sigma == pytest.approx(math.degrees(math.acos(min(1.0, math.hypot(x, y)))), abs=1e-6)
        else:
            assert value == pytest.approx(w1 * a + w2 * b) and sigma == pytest.approx(abs(a - b) * math.hypot(w1, w2))
    stats = {x["field"]: x for x in rb.agreement(values).collect()}
    d = [corrected(1, t, "ws10") - corrected(2, t, "ws10") for t in times if None not in (corrected(1, t, "ws10"), corrected(2, t, "ws10"))]
    assert stats["ws10"]["n"] == len(d) and stats["ws10"]["rmsd"] == pytest.approx(math.sqrt(sum(x * x for x in d) / len(d))) and 0 < stats["ws10"]["consistency"] < 1
    assert stats["ws10"]["monthly_swing"] == 0.0 and stats["ws10"]["diurnal_swing"] > 0


def test_agreement_of_a_constant_field_has_no_r(spark):
    """A field that one station never changes: r is NaN, as DuckDB's corr gives it, and the query does not fail."""
    rows = [(1, datetime.datetime(2024, 1, 1 + k // 24, k % 24), field, 2.0, v2) for k in range(48) for field, v2 in (("wcode", float(k % 3)), ("cloud", 2.0))]
    rows += [(1, t, "ws10", v2, 3 - 2 * v2) for _, t, field, _, v2 in rows if field == "wcode"]
    got = {x["field"]: x for x in rb.agreement(spark.createDataFrame(rows, "pair int, time timestamp_ntz, field string, v1 double, v2 double")).collect()}
    assert math.isnan(got["wcode"]["r"]) and math.isnan(got["cloud"]["r"]) and got["ws10"]["r"] == pytest.approx(-1.0)
    assert got["cloud"]["n"] == 48 and got["cloud"]["rmsd"] == 0.0 and got["cloud"]["consistency"] == 1.0
