"""Two-pass percentiles against NumPy: large and small groups, ties, nulls, and a plan without a buffer of values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import extremes, quantiles

QS = (0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 0.9999, 1.0)


@pytest.fixture(scope="module")
def groups(spark):
    r = np.random.default_rng(2)
    parts = {
        "normal": r.normal(0, 5, 120_000), "heavy": np.exp(r.normal(0, 6, 90_000)) * r.choice([-1, 1], 90_000), "ties": r.integers(0, 3, 70_000).astype(float), "one_value": np.full(60_000, 4.25),
        "small": r.normal(0, 1, 37), "two": np.array([1.0, 2.0]), "single": np.array([7.5]),
    }
    df = pd.DataFrame({"g": np.repeat(list(parts), [len(v) for v in parts.values()]), "x": np.concatenate(list(parts.values()))}).sample(frac=1, random_state=1)
    rows = spark.createDataFrame(df).unionByName(spark.createDataFrame([("small", None), ("none", None), (None, 3.0), (None, 5.0)], "g string, x double"))
    return rows.repartition(7).cache(), parts | {None: np.array([3.0, 5.0])}


@pytest.mark.parametrize("bound", [None, 10])
def test_equal_to_numpy(groups, bound):
    rows, parts = groups
    got = {(r["g"], r["q"]): r["value"] for r in quantiles.percentiles_long(rows, ["g"], ("x",), list(QS), bound).collect()}
    assert set(got) == {(g, q) for g in parts for q in QS}
    for (g, q), value in got.items():
        assert value == pytest.approx(float(np.quantile(parts[g], q)), rel=1e-12, abs=1e-12), (g, q)


def test_equal_to_the_aggregate_that_holds_all(groups):
    rows, _ = groups
    ours = {r["g"]: (r["a"], r["b"]) for r in quantiles.percentiles(rows, ["g"], {"a": ("x", 0.37), "b": ("x", 0.995)}, 10).collect()}
    theirs = {r["g"]: (r["a"], r["b"]) for r in rows.where("x is not null").groupBy("g").agg(F.percentile("x", 0.37).alias("a"), F.percentile("x", 0.995).alias("b")).collect()}
    assert set(ours) == set(theirs)
    for g, pair in theirs.items():
        assert ours[g] == pytest.approx(pair, rel=1e-12)


def test_only_brackets_are_ranked(groups):
    """Of a large group only a small share of its values comes to the second shuffle."""
    rows, parts = groups
    found = quantiles.brackets(rows.where("g = 'normal'").select("g", F.lit("x").alias("field"), "x"), ["g"], [0.5], quantiles.ACCURACY).first()
    inside = int(((parts["normal"] >= found["low"]) & (parts["normal"] <= found["high"])).sum())
    assert 2 <= inside <= 0.002 * len(parts["normal"])


def test_no_buffer_of_values_in_the_plan(groups):
    rows, _ = groups
    plan = quantiles.percentiles(rows, ["g"], {"a": ("x", 0.5)}, 10)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan and "percentile_approx" in plan


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert quantiles.percentiles_long(none, ["g"], ("x",), [0.5], 3).count() == 0
    assert quantiles.percentiles(none, [], {"a": ("x", 0.5)}, 1).first()["a"] is None
    table = extremes.percentile_table(spark.createDataFrame([(1.0, 5.0), (2.0, None)], "x double, y double"), ("x", "y"), (0.5,))
    assert sorted(map(tuple, table.collect())) == [("x", 0.5, 1.5), ("y", 0.5, 5.0)]
