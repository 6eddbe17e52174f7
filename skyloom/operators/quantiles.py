"""Exact percentiles of groups of any size in two passes, without a buffer of a group's values.

The first pass keeps a sketch of bounded size a group, whose rank error has a bound; its values around a percentile bracket
the wanted ranks. The second pass counts exactly: what lies below a bracket is one number, and only the distinct values
inside, a share of about 8 / ACCURACY of the rows, are counted one by one and ranked. That the ranks do lie inside is
checked against the counts, so a result is exact or the query fails; it is never near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 1 / rank error of the sketch, and how many such errors a bracket reaches to either side.
ACCURACY, REACH = 20_000, 4
#: Most rows of brackets that are broadcast: groups, whose number the caller bounds, times percentiles.
BROADCAST_ROWS = 100_000


def brackets(long: DataFrame, keys: list[str], qs: list[float], accuracy: int) -> DataFrame:
    """keys, field and, for each q, the lower and upper end of its bracket and the rank position, from one aggregate of sketches."""
    ends = [min(1.0, max(0.0, q + side * REACH / accuracy)) for q in qs for side in (-1, 1)]
    sketched = long.groupBy(*keys, "field").agg(F.count("x").alias("n"), F.percentile_approx("x", ends, accuracy).alias("e"), F.min("x").alias("least"), F.max("x").alias("most"))

    def one(i: int, q: float) -> Column:
        # in a small group the bracket, less than two ranks wide, could miss a neighbour: it takes all values, whose number is bounded
        whole = F.col("n") <= accuracy // 2
        low = F.when(whole | F.lit(ends[2 * i] == 0.0), F.col("least")).otherwise(F.col("e")[2 * i])
        high = F.when(whole | F.lit(ends[2 * i + 1] == 1.0), F.col("most")).otherwise(F.col("e")[2 * i + 1])
        return F.struct(F.lit(q).alias("q"), low.alias("low"), high.alias("high"), (F.lit(q) * (F.col("n") - 1)).alias("position"))

    return sketched.select(*keys, "field", F.explode(F.array(*[one(i, q) for i, q in enumerate(qs)])).alias("b")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("field").alias("_field"), "b.*")


def percentiles_long(df: DataFrame, keys: list[str], fields: tuple[str, ...], qs: list[float], groups: int | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """keys, field, q and value (linear interpolation) of every group and field that has values; null keys are a group.

    `groups` bounds the number of groups by the nature of the keys (hours, months, classes); without it nothing is broadcast.
    """
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("p")).select(*keys, "p.field", "p.x").where("x is not null")
    found = brackets(long, keys, qs, accuracy)
    if groups is not None and groups * len(fields) * len(qs) <= BROADCAST_ROWS:
        found = F.broadcast(found)
    match = F.col("field") == F.col("_field")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = F.when(F.col("x") >= F.col("low"), F.col("x"))
    target = [*keys, "field", "q"]
    counted = long.join(found, match).where("x <= high").groupBy(*target, "position", inside.alias("y")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*target).orderBy(F.col("y").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto)
    lower, upper = F.floor("position"), F.ceil("position")
    at = ranked.groupBy(*target).agg(
        F.first("position").alias("position"), F.max(F.when(F.col("y").isNull(), F.col("upto"))).alias("below"), F.min(F.when(F.col("upto") > lower, F.col("y"))).alias("a"), F.min(F.when(F.col("upto") > upper, F.col("y"))).alias("b")
    )
    missed = (F.coalesce("below", F.lit(0)) > F.floor("position")) | F.col("b").isNull()
    part = F.col("position") - F.floor("position")
    value = F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket: ask for a higher accuracy")).cast("double")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    return at.select(*target, value.alias("value"))


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], groups: int | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """One row a group: keys and a column for each name of `wanted` (field, q); one row of all rows without keys."""
    fields, qs = tuple(dict.fromkeys(f for f, _ in wanted.values())), sorted({q for _, q in wanted.values()})
    long = percentiles_long(df, keys, fields, qs, groups, accuracy)
    return long.groupBy(*keys).agg(*[F.max(F.when((F.col("field") == f) & (F.col("q") == q), F.col("value"))).alias(n) for n, (f, q) in wanted.items()])


def with_percentiles(rows: DataFrame, summary: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], groups: int | None = None) -> DataFrame:
    """`summary` (one row a group of `rows`) with the percentiles of `wanted`, in the place of an aggregate that holds all values."""
    found = percentiles(rows, keys, wanted, groups)
    renamed = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *wanted)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return summary.join(F.broadcast(renamed) if groups is not None and groups <= BROADCAST_ROWS else renamed, match, "left").drop(*[f"_{k}" for k in keys])
