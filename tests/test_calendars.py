"""Invariants of the calendars, the geometry and the weights."""

import datetime

import pytest
from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators import blending
from skyloom.operators import calendars as cal
from skyloom.operators import wind


@pytest.fixture(scope="module")
def years(spark):
    return spark.range(1990, 2031).select(F.col("id").alias("py"))


def test_traditional_spans_are_contiguous(years):
    rows = cal.traditional(years).orderBy("py", "mangsa").collect()
    assert len(rows) == 41 * 12
    for a, b in zip(rows, rows[1:], strict=False):
        assert b["start"] == a["stop"] + datetime.timedelta(days=1)


def test_calibrated_spans_are_contiguous(years):
    for key, *_ in cal.SCENARIOS:
        rows = cal.calibrated(years).where(F.col("scenario") == key).orderBy("py", "mangsa").collect()
        for a, b in zip(rows, rows[1:], strict=False):
            assert b["start"] == a["stop"] + datetime.timedelta(days=1)


def test_javanese_round_trip(spark):
    dates = spark.sql("select explode(sequence(date'1633-07-08', date'2100-12-31', interval 37 day)) as date")
    j = cal.javanese(dates)
    assert j.count() == dates.count()
    names = F.array(*[F.lit(m) for m in cal.MONTH_NAMES])
    back = cal.from_javanese(j.select("jyear", (F.array_position(names, F.col("month")) - 1).cast("int").alias("month_no"), "day", F.col("date").alias("was")))
    assert back.where("date is null or date <> was").count() == 0


def test_known_javanese_dates(spark):
    row = cal.javanese(spark.sql("select date'1633-07-08' as date")).first()
    assert (row["jyear"], row["month"], row["day"], row["dina"], row["pasaran"]) == (1555, "Sura", 1, "Jum'at", "Legi")
    assert cal.javanese(spark.sql("select date'1600-01-01' as date")).count() == 0


def test_season_year_and_rounding(spark):
    df = spark.createDataFrame([(datetime.date(2023, 6, 21),), (datetime.date(2023, 6, 22),), (datetime.date(2024, 6, 21),)], "d date")
    assert [tuple(r) for r in df.select(c.season_year("d"), c.season_day("d"), c.season_day_mod("d")).collect()] == [(2022, 364, 364), (2023, 0, 0), (2023, 365, 0)]
    half = spark.createDataFrame([(2020, 0.5), (2020, 1.5), (2020, 2.5)], "y int, d double")
    assert [r[0].day for r in half.select(c.season_date("y", "d")).collect()] == [22, 24, 24]


def test_mangsa_wraps(spark):
    days = spark.createDataFrame([(0.0,), (18.9,), (19.0,), (338.34,), (364.0,)], "d double")
    assert [r[0] for r in days.select(wind.mangsa_of("d")).collect()] == [12, 12, 1, 12, 12]


def test_overlap_weights_sum_to_one(spark):
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 30.0, 300.0), (3, 350.0, 380.0)], "id long, s double, e double")
    sums = {r["id"]: r["w"] for r in cal.overlap_weights(spans).groupBy("id").agg(F.sum("w").alias("w")).collect()}
    assert set(sums) == {2, 3} and all(abs(w - 1) < 1e-9 for w in sums.values())


def test_span_of_one_mangsa_is_its_climatology(spark):
    spans = spark.createDataFrame([(1, 94.0, 124.0, "NETRAL", "NETRAL")], "id long, s double, e double, enso string, iod string")
    r = cal.span_climatology(spans).first()
    assert (r["rain_d"], r["t_max"], r["wet_days"], r["x_max"]) == (2.8, 34.3, 9, 38.5)


def test_good_days_follow_the_groups(spark):
    got = cal.good_days(spark.createDataFrame([(1, 30)], "id long, total int")).collect()
    assert {r["neptu"] % 3 for r in got} == {2} and ("Senin", "Pon") not in {(r["dina"], r["pasaran"]) for r in got} and len(got) == 7


def test_circular_functions(spark):
    df = spark.createDataFrame([(350.0,), (10.0,)], "d double")
    r = df.agg(c.circular_mean("d").alias("m"), c.resultant_length("d").alias("r"), c.circular_std("d").alias("s")).first()
    assert min(r["m"], 360 - r["m"]) < 1e-6 and abs(r["r"] - 0.98480775) < 1e-6 and 9.5 < r["s"] < 10.5
    assert spark.sql("select 1").select(c.circular_difference(F.lit(180.0), F.lit(0.0))).first()[0] == -180.0
    assert spark.sql("select 1").select(c.sector_name(F.lit(359.0)), c.sector_name(F.lit(22.5)), c.beaufort(F.lit(1.0))).first()[:] == ("N", "NE", 1)


def test_weights_and_geometry(spark):
    df = spark.createDataFrame([(-7.0, 110.0, -7.0, 109.9, -7.0, 110.2)], "t_lat double, t_lon double, s1_lat double, s1_lon double, s2_lat double, s2_lon double")
    r = blending.baseline(df).first()
    assert abs(r["along"] - 1 / 3) < 1e-6 and abs(r["across"]) < 1e-6 and abs(r["d2"] / r["d1"] - 2) < 1e-3
    w1, w2 = blending.inverse_distance_weights(F.lit(1.0), F.lit(2.0))
    assert spark.range(1).select(w1, w2).first()[:] == (0.8, 0.19999999999999996)
    assert spark.range(1).select(blending.inverse_distance_weights(F.lit(0.0), F.lit(2.0))[0]).first()[0] == 1.0


def test_blend_falls_back_to_what_is_there(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (1.0, None), (None, None)], "x double, y double")
    assert [r[0] for r in df.select(F.round(blending.scalar_blend("x", "y", (0.25, 0.75)), 6)).collect()] == [2.5, 3.0, 1.0, None]
    assert df.select(blending.direction_blend("x", "y", (0.5, 0.5), fallback=False).alias("d")).where("d is null").count() == 3
