"""p-values against closed forms and series, and the calendar table function against the plan."""

import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions import significance, tables
from skyloom.operators import calendars as cal


def student(t: float, df: int) -> float:
    """Two-sided p for whole df, by the finite series in the angle."""
    a = math.atan(abs(t) / math.sqrt(df))
    if df == 1:
        return 1 - 2 * a / math.pi
    s, c = math.sin(a), math.cos(a)
    if df % 2:
        term = total = c
        for k in range(3, df - 1, 2):
            term *= (k - 1) / k * c * c
            total += term
        return 1 - 2 / math.pi * (a + s * total)
    term = total = 1.0
    for k in range(1, df - 2, 2):
        term *= k / (k + 1) * c * c
        total += term
    return 1 - s * total


def test_student_p_values(spark):
    cases = [(t, df) for df in (1, 2, 3, 4, 5, 9, 10, 30, 101, 1000, 20_001) for t in (0.0, 1e-6, 0.3, 1.0, 1.96, 2.5, 4.0, 9.0)]
    rows = spark.createDataFrame([(t, float(df)) for t, df in cases] + [(-2.5, 9.0)], "t double, df double")
    got = {(r["t"], int(r["df"])): r["p"] for r in rows.withColumn("p", significance.t_p_value(F.col("t"), F.col("df"))).collect()}
    for t, df in cases:
        assert got[t, df] == pytest.approx(student(t, df), abs=1e-10), (t, df)
    assert got[-2.5, 9] == got[2.5, 9]
    # tabulated two-sided critical values
    for t, df, p in ((12.7062047364, 1, 0.05), (2.2281388520, 10, 0.05), (2.7499956536, 30, 0.01), (3.2905267315, 10**7, 0.001)):
        value = spark.range(1).select(significance.t_p_value(F.lit(t), F.lit(float(df)))).first()[0]
        assert value == pytest.approx(p, abs=1e-9 if df < 1000 else 1e-6)


def test_incomplete_beta_and_edges(spark):
    one = lambda a, b, x: spark.range(1).select(significance.incomplete_beta(F.lit(a), F.lit(b), F.lit(x))).first()[0]
    assert one(1.0, 1.0, 0.3) == pytest.approx(0.3, abs=1e-12) and one(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert one(5.5, 2.25, 0.8) + one(2.25, 5.5, 0.2) == pytest.approx(1.0, abs=1e-12)
    assert (one(1.0, 2.0, 0.0), one(1.0, 2.0, 1.0), one(1.0, 2.0, 1.5), one(-1.0, 2.0, 0.5)) == (0.0, 1.0, None, None)
    r = spark.createDataFrame([(1.0, 5), (0.5, 2), (0.5, 27), (None, 9)], "r double, n int").select(significance.r_p_value(F.col("r"), F.col("n"))).collect()
    assert [x[0] for x in r[:2]] == [0.0, None] and r[2][0] == pytest.approx(student(0.5 * math.sqrt(25 / 0.75), 25), abs=1e-10) and r[3][0] is None
    for z in (0.5, 1.0, 3.7, 40.0, 1e5):
        assert spark.range(1).select(significance.log_gamma(F.lit(z))).first()[0] == pytest.approx(math.lgamma(z), rel=1e-13, abs=1e-12)


def test_calendar_table_function(spark):
    tables.register(spark)
    years = spark.range(1990, 2040).select(F.col("id").alias("py"))
    expected = sorted((r["scenario"], r["py"], r["mangsa"], r["start"], r["stop"], r["days"]) for r in cal.calibrated(years).collect())
    keys = spark.createDataFrame([(k,) for k, *_ in cal.SCENARIOS], "scenario string")
    got = spark.sql("SELECT c.* FROM {y} y CROSS JOIN {k} k, LATERAL calendar(y.py, k.scenario) c", y=years, k=keys).collect()
    assert sorted((r["scenario"], r["py"], r["mangsa"], r["start"], r["stop"], r["days"]) for r in got) == expected
    wanted = years.crossJoin(keys).union(years.crossJoin(keys)).repartition(4)
    parted = spark.sql("SELECT * FROM calendar_of(TABLE(SELECT py, scenario FROM {w}) PARTITION BY scenario ORDER BY py)", w=wanted).collect()
    assert sorted((r["scenario"], r["py"], r["mangsa"], r["start"], r["stop"], r["days"]) for r in parted) == expected
    assert spark.sql("SELECT * FROM calendar(2020, 'unknown')").count() == 0 and spark.sql("SELECT * FROM calendar(NULL, NULL)").count() == 0
