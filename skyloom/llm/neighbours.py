"""Operator 5: approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to unit length, rotated onto `DIMS` random directions and, once for each of `CURVES` shifts and
rotations, put in the order of a Hilbert curve over the grid of their projections. Spark range-partitions the keys and
numbers the rows, so a curve is a sequence of blocks of equal size. A query reads the blocks within `width` places of
its own on every curve; each block scores its queries by one matrix product, in double precision on the original
vectors, and the best of all curves are merged.

The width is calibrated, not fixed: for a bounded sample of queries the true neighbours are found by brute force, and
`width` is the least number of places within which `TARGET` of them lie on at least one curve. Data that falls into
clusters needs few blocks; data without structure (independent directions) need most of the table, and get it.

Equal vectors are one entry with the `k` + 1 smallest of their ids, which stand for all in ties, however many there are.

Defined results: vectors null, zero or with null or non-finite components take no part; repeated rows are one candidate;
a null vec_id takes no part; fewer than k candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import global_rank, pick, stored, table

K, CURVES, DIMS, BITS = 20, 4, 8, 6
#: Rows of a block: a quarter of the width, so that a query reads about nine blocks of a curve, between these bounds.
LEAST_BLOCK, MOST_BLOCK = 512, 65536
#: Queries of a block that are scored in one group.
MOST_QUERIES = 4096
#: Queries of the calibration, and the share of true neighbours that it aims at.
SAMPLE, TARGET = 48, 0.97


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows x dims, `bits` each): Skilling's transpose form, vectorised."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors on one curve: its own rotation, and a shift of the grid."""
    random = np.random.default_rng(1000 + curve)
    axes = np.linalg.qr(random.normal(size=(vectors.shape[1], min(dims, vectors.shape[1]))))[0]
    spread = 3.5 / np.sqrt(vectors.shape[1])
    shift = random.uniform(0, 1, axes.shape[1])
    cells = np.floor((np.clip(vectors @ axes, -spread, spread) / (2 * spread) + 0.5) * ((1 << bits) - 2) + shift)
    return hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column], np.float64).reshape(len(column), -1)


def entries(embeddings: DataFrame, k: int) -> DataFrame:
    """(entry, vector, ids): the distinct usable vectors, each with its k + 1 smallest ids."""
    vector = F.col("embedding").cast("array<double>")
    usable = embeddings.where("vec_id is not null").select("vec_id", vector.alias("vector")).where(
        F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    ).distinct()
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = usable.withColumn("n", nth).where(F.col("n") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("entry"), "vector", "ids")


def on_curves(vectors: DataFrame, curves: int) -> DataFrame:
    """(curve, key, entry) for every entry and curve."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = matrix(batch["vector"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for c in range(curves):
                    yield pd.DataFrame({"curve": c, "key": curve_keys(x, c), "entry": batch["entry"].to_numpy()})

    return vectors.select("entry", "vector").mapInPandas(keys, "curve int, key long, entry long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among (query, vec_id, score)."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scored(block_rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score): the best k of each query in each group `g` of entries."""

    def score(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(asked):
            return pd.DataFrame({"query": [], "entry": [], "score": []})
        x = matrix(group["vector"])
        out = []
        for at in range(0, len(asked), 512):
            part = asked.iloc[at : at + 512]
            s = np.stack([x @ q for q in matrix(part["vector"])])
            # an entry of the query's own vector counts too (other ids may hold it), so one more is kept; ties are kept whole
            cut = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)][:, None] if s.shape[1] > k + 1 else np.full((len(s), 1), -np.inf)
            i, j = np.nonzero(s >= cut)
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[i], "entry": group["entry"].to_numpy()[j], "score": s[i, j]}))
        return pd.concat(out)

    # however many queries ask for a block, a group holds at most about MOST_QUERIES of them; the block is sent to each
    chunks = queries.groupBy("g").agg(F.ceil(F.count("*") / MOST_QUERIES).cast("int").alias("c"))
    asked = queries.join(chunks, "g").select("g", F.pmod(F.xxhash64("query"), "c").cast("int").alias("h"), "query", "vector")
    copies = chunks.select(F.col("g").alias("block"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("h"))
    rows = block_rows.join(copies, block_rows["g"] == copies["block"]).select("g", "h", "entry", "vector")
    return rows.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInPandas(score, "query long, entry long, score double")


def expand(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """From entries to ids: the best k + 1 entries of a query (ties to the smaller id) hold its best k ids other than its own."""
    top = best(found.distinct().withColumnRenamed("entry", "vec_id"), k + 1).select("query", F.col("vec_id").alias("entry"), "score")
    ids = top.join(members, "entry").select("query", F.explode("ids").alias("vec_id"), "score").where("vec_id != query")
    return best(ids, k)


def calibrated_width(ranked: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, curves: int) -> int:
    """Least distance in places that covers TARGET of the true neighbours of at most SAMPLE queries, on the best curve for each."""
    sample = queries.orderBy(F.xxhash64("query")).limit(SAMPLE)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = vectors.select("entry", "vector", F.pmod(F.xxhash64("entry"), F.lit(parts)).alias("g"))
    asked = sample.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    true = best(scored(dealt, asked, k).where("entry != query").select("query", F.col("entry").alias("vec_id"), "score"), k)
    place = ranked.select("curve", "entry", "rank")
    own = sample.select("query", "entry").join(place, "entry").select("query", "curve", F.col("rank").alias("own"))
    apart = true.select("query", F.col("vec_id").alias("entry")).join(place, "entry").join(own, ["query", "curve"]).groupBy("query", "entry").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("d"))
    cut = apart.agg(F.percentile("d", TARGET)).first()[0]
    return int(cut or 0) + 1


def nearest(embeddings: DataFrame, is_query, k: int = K, curves: int = CURVES) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` nearest found for the rows that the Column `is_query` picks."""
    every = stored(entries(embeddings, k), "entries")
    vectors = every.select("entry", "vector")
    asked_ids = embeddings.where(is_query & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("vector")).distinct()
    queries = stored(asked_ids.join(every.select("entry", "vector"), "vector"), "queries")
    ranked = stored(global_rank(on_curves(vectors, curves), [F.col("curve"), F.col("key"), F.col("entry")], "curves"), "ranked")
    width = calibrated_width(ranked, vectors, queries, k, curves)
    block = min(MOST_BLOCK, max(LEAST_BLOCK, width // 4))
    number = F.struct("curve", F.floor(F.col("rank") / block).alias("b"))
    candidates = ranked.join(vectors, "entry").select(number.alias("g"), "entry", "vector")
    around = F.sequence(F.floor(F.greatest(F.col("rank") - width, F.lit(0)) / block), F.floor((F.col("rank") + width) / block))
    spots = queries.join(ranked, "entry").select("query", "vector", "curve", F.explode(around).alias("b")).select("query", "vector", F.struct("curve", "b").alias("g"))
    found = scored(candidates, spots, k)
    return expand(found, every.select("entry", "ids"), k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("vec_id") % 20 == 0)
