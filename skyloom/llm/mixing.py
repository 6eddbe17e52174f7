"""Operator 7: mix sources to target weights by repetition rates.

Tokens are summed per source; the targets share the total by weight, none above `cap` times its source's size; a
source's rate is target / size. Each document is emitted floor(rate) times, plus once more if a hash of its id with the
seed falls below the fraction. The plan needs one small aggregate; water-filling looks at sums only, and copies are made
by exploding each row in place, so no source, however hot, is gathered anywhere.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own and comes last; rows
with equal ids take the same decision; a null id is hashed as the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import global_rank, pick, small, stored, table

WEIGHTS, CAP, SEED = (5.0, 2.0, 1.0), 3, "mix-1"


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    The level rises until no target is above its cap: each round freezes the capped sources and shares the rest by
    weight again. A round is one aggregate of the table of sources; the driver sees two numbers.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(summed.withColumn("_last", F.col("source").isNull()), [F.col("_last"), F.col("source")], "sources", 4)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("source", "source_size", weight.alias("w")), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, most = 0.0, F.col("source_size") * cap
    free = F.lit(True)
    while total:
        capped, left = sources.agg(F.sum(F.when(~free, F.col("source_size")).otherwise(0)), F.sum(F.when(free, F.col("w")).otherwise(0.0))).first()
        if not left:
            break
        again, level = level, (total - cap * capped) / left
        free = F.col("w") * F.lit(level) <= most
        if again == level:
            break
    return sources.select("source", "source_size", F.when(F.col("w") * F.lit(level) <= most, F.col("w") * F.lit(level)).otherwise(most.cast("double")).alias("target"))


def copies(seed: str = SEED, cap: int = CAP) -> Column:
    """Times a document is taken, from columns doc_id, source_size and target."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    return F.least(F.floor(rate) + F.when(bits / F.lit(4294967296.0) < rate - F.floor(rate), 1).otherwise(0), F.lit(cap)).cast("long")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """`docs` with size, source_size, target and copies for every row."""
    sized = docs.withColumn("size", word_count())
    targets = source_targets(sized.select("source", "size"), weights, cap).withColumnRenamed("source", "_source")
    joined = sized.join(small(targets, items=F.length("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("copies", copies(seed, cap))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it; `copy` numbers the copies from 1."""
    taken = mixed(docs).where("copies > 0")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w FROM s
), o AS (
  SELECT *, source_size / w AS ratio,
         coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         sum(source_size) OVER () AS total
  FROM r
), l AS (
  SELECT min_by(CAST(total - 3 * below AS DOUBLE) / w_left, ratio) AS level
  FROM o WHERE CAST(total - 3 * below AS DOUBLE) / w_left <= 3 * ratio
), t AS (
  SELECT source, source_size, CASE WHEN w * coalesce(level, 0) <= source_size * 3 THEN w * coalesce(level, 0) ELSE CAST(source_size * 3 AS DOUBLE) END AS target
  FROM r, l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * least(CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS taken
FROM c
"""
