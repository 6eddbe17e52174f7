"""Operator 12: exact integer k-means by annulus search.

Vectors become integers once and are stored with their norms. A round needs the centroids only (k rows of fixed width, sent
to every task): they are sorted by norm, a vector's distance to the centroid of nearest norm is an upper bound u, and by
the triangle inequality no centroid whose norm differs from the vector's by more than u can be nearer. The two ends of that
annulus are found by binary search, widened by more than the rounding error so that ties on the boundary stay in, and the
centroids between them are compared exactly, in integers. A round returns one sum per cluster and component, combined on the
map side; no vector leaves its task, and a lost task is computed again from the stored table.

Defined results: vectors that are null, of another length than `size`, or hold null or non-finite components take no part;
nor do vectors with a component beyond `LIMIT` in size after scaling, whose squared distances need not fit a long. Fewer
vectors than `k` give as many centroids as there are vectors. Repeated rows count each; rows of equal id and different vectors
start in the order of their components; a null vec_id is hashed as the empty text and keeps its row; empty tables give an
empty result; extra columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import discard, pick, stored, table

K, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: Largest integer component: 64 squared differences of such components fit a long.
LIMIT = 1 << 27


def integer_vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and x (array of longs, floor(scale * component)) of the vectors that take part."""
    inside = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= LIMIT / scale))
    kept = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == size) & inside)
    return kept.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids: a top-k report, k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(key, "x").limit(k).select("x").collect()
    return np.array([r[0] for r in rows], np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and exact squared distance of each row."""
    norm_c, norm_x = (np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) for v in (centroids, x))
    order = np.lexsort((np.arange(len(centroids)), norm_c))
    norm_c = norm_c[order]
    right = np.clip(np.searchsorted(norm_c, norm_x), 0, len(order) - 1)
    left = np.maximum(right - 1, 0)
    seed = order[np.where(np.abs(norm_c[left] - norm_x) < np.abs(norm_c[right] - norm_x), left, right)]

    def exact(rows: np.ndarray, of: np.ndarray | int) -> np.ndarray:
        return ((x[rows] - centroids[of]) ** 2).sum(axis=1)

    best, number = exact(np.arange(len(x)), seed), seed.copy()
    reach = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (norm_x + reach) + 1e-3
    low = np.searchsorted(norm_c, norm_x - reach - slack, "left")
    high = np.searchsorted(norm_c, norm_x + reach + slack, "right")
    for at, c in enumerate(order.tolist()):
        rows = np.flatnonzero((low <= at) & (at < high) & (seed != c))
        if len(rows):
            d = exact(rows, c)
            nearer = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            best[rows[nearer]], number[rows[nearer]] = d[nearer], c
    return number, best


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of the vectors nearest to each centroid; empty ones stay."""
    k, size = centroids.shape
    names = [f"s{i}" for i in range(size)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            number, _ = assigned(x, centroids)
            for c in range(k):
                rows = x[number == c]
                total[c, 0] += len(rows)
                total[c, 1:] += rows.sum(axis=0)
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, i]) for i in range(size + 1)]], ["cluster", "n", *names])

    parts = vectors.select("x").mapInArrow(partial, "cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(s) for s in names]).collect():
        out[row[0]] = np.array(row[2:], np.int64) // row[1]
    return out


def clustered(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    vectors = stored(integer_vectors(embeddings, size, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, best = assigned(matrix(batch.column("x")), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    found = stored(vectors.mapInArrow(final, "vec_id long, cluster int, distance long"), "clusters")
    discard(vectors)
    return found, centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # a window without a key over at most k rows
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    whole = sums.join(F.broadcast(named), "cluster")
    return found.join(F.broadcast(whole), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in plain steps: all distances to all centroids, one pair of tables for each round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(CAST(e AS DOUBLE)) <= {LIMIT / scale})) = {size})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS INT) AS c, x FROM v QUALIFY c < {k})",
    ]
    nearest = "SELECT v.r, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, n.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := n.c)) AS m FROM v, c{0} n GROUP BY v.r"
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        # an exact integer quotient of HUGEINT, rounded down
        steps.append(
            f"""c{i + 1} AS MATERIALIZED (
  SELECT n.c, coalesce(s.x, n.x) AS x FROM c{i} n LEFT JOIN (
    SELECT c, list(CAST(CASE WHEN t >= 0 THEN t // k ELSE -((k - 1 - t) // k) END AS BIGINT) ORDER BY j) AS x FROM (
      SELECT c, j, sum(e) AS t, count(*) AS k FROM (SELECT a{i}.m.c AS c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j) GROUP BY c) s ON s.c = n.c)"""
        )
    steps.append(f"f AS MATERIALIZED ({nearest.format(rounds)})")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, f.m.c AS cluster, CAST(f.m.d AS BIGINT) AS distance, CAST(sum(f.m.d) OVER (PARTITION BY f.m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(f.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(n.x, ',')) AS centroid_sha256
FROM v JOIN f USING (r) JOIN c{rounds} n ON n.c = f.m.c"""
