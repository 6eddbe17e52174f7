"""Operator 2: substring dedup by paragraph MinHash banding.

Paragraphs are of two kinds. Lines of at least `RUN_WORDS` words are paragraphs by themselves: those whose five-word
shingles reach a Jaccard similarity of 0.8 are found by MinHash banding (8 bands of 4 rows: a pair at 0.8 collides with
probability 0.985, at 0.9 with 0.9999), verified exactly, and clustered by components. Passages that stand anywhere
inside other text do not begin where a line begins, so texts are also cut at content-defined places (the local minima of
a hash of three words): a passage is cut alike wherever it stands. These pieces are paragraphs too short for bands, and
are matched whole. Of each cluster the first paragraph (by doc_id, then place) stays, and runs of at least `RUN_WORDS`
consecutive words that later paragraphs cover are removed; shorter repeats, such as common lines and phrases, stay.

A passage loses what stands before its first and after its last cut, some nine words on each side, so one of 50 words that
repeats word for word is covered by 32 or more almost always. A passage that repeats with changed words is found as a line; inside
a longer line only its unchanged stretches are, where they are long enough.

Texts are read once: a stored table has a row for each paragraph, and once a task for each line its bands and its shingles.
Counts, bands and clusters cover all documents. No group leaves a task as pairs but in small or sparse groups.

Defined results: null and empty texts have no words and nothing is removed; a null doc_id comes last in the order;
repeated rows repeat their paragraphs; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import discard, pick, release, small, stored, table
from skyloom.llm.similarity import BITS, ROUNDS, WIDE, WIDTH, candidates, linked_classes, packed, sets_among, signatures
from skyloom.llm.words import BASE, Reader, Rolling, Slab, mixed, slabs

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 8, 4
RUN_WORDS, PIECE_WORDS, REACH = 32, 5, 4
#: Shingles whose MinHash is taken at once, and lines of a task that have been given.
SLAB, REMEMBERED = 4096, 1 << 19


def pieces_of(slab: Slab, rolling: Rolling, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops (words of the slab) of the content-defined pieces of all its texts."""
    n = len(slab.hashes)
    edges = np.unique(slab.bounds)
    if n > 2 * REACH + 3:
        place = np.arange(n - 2)
        threes = rolling.of(sums, place, place + 3)
        first, last = slab.bounds[slab.text[:-2]], slab.bounds[slab.text[:-2] + 1] - 3
        threes[place > last] = np.iinfo(np.uint64).max
        least = np.lib.stride_tricks.sliding_window_view(threes, 2 * REACH + 1).min(axis=1)
        centre = np.flatnonzero(threes[REACH : len(threes) - REACH] == least) + REACH
        centre = centre[(centre - REACH >= first[centre]) & (centre + REACH <= last[centre])]
        # equal hashes close together are one cut
        centre = centre[np.r_[True, np.diff(centre) >= PIECE_WORDS]] if len(centre) else centre
        edges = np.unique(np.concatenate([edges, centre]))
    start, stop = edges[:-1], edges[1:]
    keep = stop - start >= PIECE_WORDS
    return start[keep], stop[keep]


def lines_of(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the long lines."""
    at, _, _ = slab.lines()
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    stop = np.r_[start[1:], len(at)]
    keep = stop - start >= RUN_WORDS
    return start[keep], stop[keep]


def shingles_of(rolling: Rolling, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of spans of at least SHINGLE words, one after another, and the span that each belongs to."""
    counts = stop - start - SHINGLE + 1
    owner = np.repeat(np.arange(len(start)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + start[owner]
    return rolling.of(sums, at, at + SHINGLE), owner


def bands_of(shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each of n spans and each band of its MinHash signature."""
    seeds = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    least = np.full((n, BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), SLAB):
        own, part = owner[k : k + SLAB], mixed(shingles[k : k + SLAB, None] * seeds[None, :])
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        least[own[cut]] = np.minimum(least[own[cut]], np.minimum.reduceat(part, cut, axis=0))
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(BASE) + least.reshape(-1, BANDS, ROWS)[:, :, r])
    return keys


PARAGRAPHS = "doc_id long, row long, start int, stop int, class long, bands array<long>, size int" + "".join(f", {b} long" for b in BITS) + ", tokens binary"


def paragraph_table(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), start, stop and class of all paragraphs; a line's class is odd, a piece's even.

    Once a task for each line: bands, size, signature and tokens (packed) of its shingles.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rolling, seen = Reader(), Rolling(), set()
        for batch in batches:
            for slab in slabs(batch.column("text"), reader):
                if not len(slab.hashes):
                    continue
                sums = rolling.sums(slab.hashes)
                spans = [lines_of(slab), pieces_of(slab, rolling, sums)]
                start, stop = (np.concatenate([x[k] for x in spans]) for k in (0, 1))
                lines = len(spans[0][0])
                of = rolling.of(sums, start, stop) & ~np.uint64(1)
                of[:lines] |= np.uint64(1)
                of = of.view(np.int64)
                fresh = []
                for k, c in enumerate(of[:lines].tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh.append(k)
                if len(seen) > REMEMBERED:
                    seen = set()
                n, new = len(of), np.array(fresh, np.int64)
                shingles, owner = shingles_of(rolling, sums, start[new], stop[new])
                keys = bands_of(shingles, owner, len(new)).view(np.int64)
                # sets: sorted by span, then hash; a slab has fewer than 2**24 lines
                key = owner.astype(np.uint64) << np.uint64(8 * WIDTH) | shingles & np.uint64((1 << 8 * WIDTH) - 1)
                key.sort()
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                whose, token = (key >> np.uint64(8 * WIDTH)).astype(np.int64), key & np.uint64((1 << 8 * WIDTH) - 1)
                first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(key) else np.zeros(0, np.int64)
                size, bits, sets, bands = np.zeros(n, np.int32), np.zeros((WIDE, n), np.int64), [None] * n, [None] * n
                own = np.diff(np.r_[first, len(key)])
                size[new], bits[:, new] = own, signatures(token, first)
                data = packed(token)
                for k, f, m, b in zip(fresh, first.tolist(), own.tolist(), keys, strict=True):
                    sets[k], bands[k] = data[f * WIDTH : (f + m) * WIDTH], b
                mask = np.ones(n, bool)
                mask[new] = False
                text = slab.text[start]
                rows = pa.array(slab.rows[0] + text)
                begin = slab.bounds[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("row").take(rows), pa.array((start - begin).astype(np.int32)), pa.array((stop - begin).astype(np.int32)), pa.array(of), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(size, mask=mask), *[pa.array(x, mask=mask) for x in bits], pa.array(sets, pa.binary())],
                    ["doc_id", "row", "start", "stop", "class", "bands", "size", *BITS, "tokens"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(cut, PARAGRAPHS)


def similar_lines(found: DataFrame) -> DataFrame:
    """(node, component) of the lines that verified pairs link to another one; they meet under their bands."""
    banded = found.where("bands is not null").select("class", (F.col("size").cast("long") * F.lit(1 << 32)).alias("shape"), *BITS, F.explode("bands").alias("token")).select("token", "class", "shape", *BITS)

    def of_bands(turn: int) -> DataFrame:
        return candidates(banded.where(F.pmod("token", F.lit(ROUNDS)) == turn), THRESHOLD, False)

    return linked_classes(found.sparkSession, of_bands, lambda wanted: sets_among(found, wanted), THRESHOLD)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, stop, cluster) of paragraphs that occur more than once, exactly or nearly; the first place of each cluster comes once more, without stop."""
    found = stored(paragraph_table(docs), "paragraphs")
    parts = similar_lines(found)
    release(docs.sparkSession)
    often = found.groupBy("class").count().where("count > 1").select("class")
    clusters = stored(often.join(parts, F.col("class") == F.col("node"), "full").select(F.coalesce("class", "node").alias("class"), F.coalesce("component", "class").alias("cluster")), "clusters")
    own = stored(found.select("doc_id", "row", "start", "stop", "class").join(small(clusters, 2_000_000), "class").drop("class"), "repeated")
    discard(found, parts, clusters)
    release(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "start", "row")
    first = own.groupBy("cluster").agg(F.min(place).alias("first")).select("first.doc_id", "first.row", "first.start", F.lit(None).cast("int").alias("stop"), "cluster")
    # the first places go to their documents; paragraphs never move to their cluster
    return own.union(first)


def runs(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Stretches of at least `least` words that the spans cover without a gap."""
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return [(a, b) for a, b in out if b - a >= least]


def substring_duplicates(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """`docs` with n_shared (words in repeated runs), n_removed (those that go), removed (spans) and cluster (smallest of its clusters)."""

    @F.pandas_udf("n_shared long, n_removed long, removed array<struct<start:long,stop:long>>")
    def summed(found: pd.Series) -> pd.DataFrame:
        rows = []
        for spans in found:
            first = {(x["start"], x["cluster"]) for x in spans if x["stop"] is None}
            every = [x for x in spans if x["stop"] is not None]
            shared = runs([(x["start"], x["stop"]) for x in every], least)
            gone = runs([(x["start"], x["stop"]) for x in every if (x["start"], x["cluster"]) not in first], least)
            rows.append((sum(b - a for a, b in shared), sum(b - a for a, b in gone), [{"start": a, "stop": b} for a, b in gone]))
        return pd.DataFrame(rows, columns=["n_shared", "n_removed", "removed"])

    per = repeated(docs.select("doc_id", "text")).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "stop", "cluster")).alias("s"), F.min("cluster").alias("cluster"))
    own = stored(per.withColumn("x", summed("s")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "x.*", "cluster").where("n_shared > 0"), "spans")
    keyed = docs.withColumn("_text_row", F.xxhash64("text"))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    return keyed.join(small(own, items=F.size("removed")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_row") == F.col("_row")), "left").select(
        *docs.columns, F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", none).alias("removed"), "cluster"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return substring_duplicates(docs).select("doc_id", "n_shared", "n_removed", spans.alias("removed_words"), "cluster")
