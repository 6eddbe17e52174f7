"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only: the contracts lower-case A-Z and leave other alphabets alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of what is not a word character for the alphanumeric word rule.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Project exactly `names`, whatever else the table holds.

    Columns are found by position, so extra columns whose names clash (also in case) do no harm.
    """
    index = [df.columns.index(n) for n in names]
    raw = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return raw.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(index, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one where it is unset.

    On a cluster a folder of one machine would be seen by that machine alone, so an unset folder is an error there.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyloom-"))
    return spark.sparkContext.getCheckpointDir()


#: Bytes of a batch that goes to a Python worker (64 MB by default): rows with texts or sets are held several times over on their way.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it again. Batches for Python are small meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skyloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_BYTES[0])
    spark.conf.set(*BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES[0], before)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


#: Bytes from which a freed array goes back to the system at once (an option of glibc, by its number).
MMAP_THRESHOLD, FREED = -3, 1 << 20


def give_back() -> None:
    """Return to the system what this worker's allocators hold back."""
    libc = ctypes.CDLL(None)
    pa.default_memory_pool().release_unused()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(handle: Callable[[Iterator], Iterator], at_once: bool = True) -> Callable[[Iterator], Iterator]:
    """`handle` of mapInArrow or mapInPandas for a worker that holds no more than the task at hand needs.

    Spark keeps Python workers for later tasks, and as many as a task of several Python steps once took; what the allocators
    of an idle one hold back counts against its executor like the heap of those at work. `at_once` gives large arrays back as
    they are freed, for some time in page faults; else only the end of a task does.
    """

    def run(batches: Iterator) -> Iterator:
        libc = ctypes.CDLL(None)
        if at_once and hasattr(libc, "mallopt"):
            libc.mallopt(MMAP_THRESHOLD, FREED)
        try:
            yield from handle(batches)
        finally:
            give_back()

    return run


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them when the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most_rows: int = 100_000, items: Column | None = None) -> DataFrame:
    """Broadcast `df` if it is counted to be small; a larger one is joined by shuffle.

    `items` tells what a row of no fixed size holds (array entries, characters): at most ten for each allowed row, in all.
    """
    held = df.select((F.lit(0) if items is None else items).alias("held")).limit(most_rows + 1)
    rows, total = held.agg(F.count("*"), F.sum("held")).first()
    return F.broadcast(df) if rows <= most_rows and (total or 0) <= 10 * most_rows else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Words of the alphanumeric rule, in order; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key() -> Column:
    """Identity of a document row: equal id and equal text are one document, joined null-safely as one value."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))


def ascii_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Batches of few documents, so that what is built from their words stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def global_rank(df: DataFrame, by: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Number the rows from 0 in the order of `by` (must be unique): range partitions, then an offset for each.

    The driver sees one count per partition, never rows.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = stored(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_mono", F.monotonically_increasing_id()), name
    )
    split = F.shiftrightunsigned("_mono", 33)
    total, offsets = 0, []
    for pid, n in sorted((r[0], r[1]) for r in numbered.groupBy(split.alias("p")).count().collect()):
        offsets.append((pid, total))
        total += n
    offset = spark.createDataFrame(offsets, "p long, o long")
    within = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("p", split)
        .join(F.broadcast(offset), "p")
        .withColumn("rank", F.col("o") + within)
        .drop("p", "o", "_mono")
    )


def spanning_links(values: np.ndarray, same_group: np.ndarray, linked, whole: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links inside runs of equal keys, found lag by lag.

    `same_group` holds the run number of each row; `linked(i, j)` tells for index arrays which pairs are linked.
    Only links that join two parts not yet connected are returned: at most one fewer than the rows of a run. Rows that
    `whole` marks give all of their pairs instead (for small runs).
    """
    n = len(values)
    root = np.arange(n)
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    live, lag = np.arange(n), 1
    while True:
        live = live[live + lag < n]
        live = live[same_group[live] == same_group[live + lag]]
        if not len(live):
            return out
        cand = live[root[live] != root[live + lag]] if whole is None else live[whole[live] | (root[live] != root[live + lag])]
        hit = cand[linked(cand, cand + lag)] if len(cand) else cand
        for i, j in zip(hit.tolist(), (hit + lag).tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
            elif whole is not None and whole[i]:
                out.append((i, j))
        if len(hit):
            flat = root[root]
            while not np.array_equal(flat, root):
                root, flat = flat, flat[flat]
            # a run whose rows are all connected has nothing more to find
            first = np.flatnonzero(np.r_[True, same_group[1:] != same_group[:-1]])
            done = np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first)
            number = np.cumsum(np.r_[True, same_group[1:] != same_group[:-1]]) - 1
            live = live[~done[number[live]]] if whole is None else live[whole[live] | ~done[number[live]]]
        lag += 1


def by_runs(batches: Iterator, key: str, handle) -> Iterator:
    """Apply `handle` to batches cut so that rows of equal `key`, which follow one another, stay together."""
    for rows, _ in pieces_of_runs(batches, key):
        yield handle(rows)


def pieces_of_runs(batches: Iterator, key: str, most: int | None = None) -> Iterator:
    """(rows, whole): batches cut so that rows of equal `key`, which follow one another, stay together.

    A run of more than `most` rows comes in pieces that are not `whole`, none of which is held for the next.
    """
    import pandas as pd

    rest, over = None, None
    for batch in batches:
        if not len(batch):
            continue
        if over is not None:
            same = batch[key].to_numpy() == over
            if same.any():
                yield batch[same], False
            batch = batch[~same]
            if not len(batch):
                continue
            over = None
        rows = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        whole = rows[key].to_numpy() != rows[key].iloc[-1]
        rest = rows[~whole]
        if whole.any():
            yield rows[whole], True
        if most is not None and len(rest) > most:
            over = rest[key].iloc[0]
            yield rest, False
            rest = None
    if rest is not None and len(rest):
        yield rest, True
