"""Greedy spacing of events by pointers: which events a scan would accept, without scanning.

Every event points to the first one far enough behind it. What a greedy scan accepts is the path of pointers from a place's
first event. The path is found by doubling: in each round accepted events accept the ends of their pointers, and
pointers are replaced by pointers of pointers, so the rounds are the logarithm of the events of the longest place.
Rows are joined by (place, number); no place's events are gathered, neither in a row nor in a task of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.sources.lineage import cut


#: Blocks of `least` numbers that are sorted together in one row.
SUPER = 1024


def pointers(events: DataFrame, least: int, keys: tuple[str, ...] = (), number: str = "rn") -> DataFrame:
    """`keys`, number and `to`, the first event at least `least` numbers on (null: none), of the distinct events.

    In blocks of `least` numbers that event stands in the next block, where an equi-join looks, or it is the first of the
    next block but one that has any; those come from lists of at most SUPER blocks and the list that follows each.
    """
    blocked = events.select(*keys, F.col(number).cast("long").alias(number)).distinct().withColumn("_b", F.floor(F.col(number) / least))
    next_block = blocked.select(*keys, F.col(number).alias("_n"), (F.col("_b") - 1).alias("_b"))
    near = blocked.join(next_block, [*keys, "_b"], "left").groupBy(*keys, number, "_b").agg(F.min(F.when(F.col("_n") >= F.col(number) + least, F.col("_n"))).alias("_near"))
    blocks = blocked.groupBy(*keys, "_b").agg(F.min(number).alias("_first"))
    lists = blocks.groupBy(*keys, F.floor(F.col("_b") / SUPER).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("_b", "_first"))).alias("_l"))
    after = Window.partitionBy(*keys, F.lit(1)).orderBy("_s")
    heads = [F.lead(F.slice("_l", 1, 2), k).over(after) for k in (1, 2)]
    joined = lists.withColumn("_all", F.concat("_l", *[F.coalesce(h, F.slice("_l", 1, 0)) for h in heads]))
    each = joined.select(*keys, F.posexplode("_l").alias("_at", "_x"), "_all").select(*keys, F.col("_x._b").alias("_b"), F.slice("_all", F.col("_at") + 2, 2).alias("_f"))
    one, two = F.get("_f", F.lit(0)), F.get("_f", F.lit(1))
    far = each.select(*keys, "_b", F.when(one["_b"] >= F.col("_b") + 2, one["_first"]).otherwise(two["_first"]).alias("_far"))
    return near.join(far, [*keys, "_b"]).select(*keys, number, F.coalesce("_near", "_far").alias("to"))


def spaced(events: DataFrame, least: int, keys: tuple[str, ...] = (), number: str = "rn") -> DataFrame:
    """Rows of `events` that a scan by `number` accepts: the first of each place, then each at least `least` after the last accepted.

    Numbers are whole; events of equal number are accepted together; null numbers are not.
    """
    known = events.where(F.col(number).isNotNull())
    first = known.groupBy(*keys).agg(F.min(number).cast("long").alias(number)).withColumn("_on", F.lit(True))
    state = cut(pointers(known, least, keys, number).join(first, [*keys, number], "left").withColumn("_on", F.coalesce("_on", F.lit(False))))
    accepted = -1
    while (now := state.where("_on").count()) != accepted:
        accepted = now
        marks = state.where("_on and to is not null").select(*keys, F.col("to").alias(number)).distinct().withColumn("_new", F.lit(True))
        jumps = state.select(*keys, F.col(number).alias("to"), F.col("to").alias("_to"))
        state = cut(state.join(marks, [*keys, number], "left").join(jumps, [*keys, "to"], "left").select(*keys, number, F.col("_to").alias("to"), (F.col("_on") | F.coalesce("_new", F.lit(False))).alias("_on")))
    return known.join(state.where("_on").select(*keys, number), [*keys, number], "left_semi")
