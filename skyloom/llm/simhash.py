"""Operator 9: SimHash near-duplicates, pairs discarded through pivot distance tables.

Every distinct fingerprint carries its table of Hamming distances to reference fingerprints (pivots). By the triangle
inequality two fingerprints within `radius` bits differ by at most `radius` in every coordinate of that table, so a
pair is discarded as soon as its largest coordinate difference is greater; only survivors are compared bit by bit.
Comparing tables of all pairs would be quadratic, so pairs meet under block keys first: fingerprints that differ in at
most 4 bits agree on at least two of six blocks, which makes 15 keys of about 21 bits. The keys lose no link.
A key with many fingerprints (a great group of near copies) is dealt out as pairs of chunks of bounded size, and from
each group only spanning links leave, never all its pairs.

Defined results: null and empty texts have fingerprint zero, which is linked like any other; repeated rows share a
fingerprint; a null doc_id keeps its row, and never is the smallest id unless a whole component has none; an empty
table gives an empty result; extra columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import ascii_words, by_runs, discard, lean, pick, spanning_links, stored, table
from skyloom.llm.components import connected_components
from skyloom.llm.similarity import BITS, ROUNDS, WIDE, linked_classes, packed, prefix_candidates, sets_among, signatures, verified
from skyloom.llm.words import Reader, Rolling, mixed, slabs

RADIUS, PIVOTS, BLOCKS, CHUNK = 4, 16, 6, 2048
#: Of the pipeline stage: five words to a shingle, and the Jaccard similarity of shingle sets from which documents are near copies.
STAGE_WORDS, STAGE_THRESHOLD = 5, 0.8
#: Shingles whose bits are counted at once.
SLAB = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """A hash of each run of `words` words, repeats included; a shorter text is one run."""
    tokens = ascii_words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    if len(tokens) <= words:
        first, last = [0], [len(joined)]
    else:
        first, last = [0, *(ends[: len(tokens) - words] + 1).tolist()], ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(first, last, strict=True)), np.uint64, len(first))


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits, each set if it is set in over half the hashes of the shingles (repeats included); 0 without words."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SLAB):
        bits = np.unpackbits(hashes[k : k + SLAB].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints_of(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each of n texts from the hashes of its shingles, repeats included; `text` (ascending) tells whose they are."""
    out = np.zeros(n, np.uint64)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    if len(first):
        of, own = text[first], np.diff(np.r_[first, len(text)])
        for b in range(64):
            over = 2 * np.add.reduceat(((hashes >> np.uint64(b)) & np.uint64(1)).astype(np.int64), first) > own
            out[of] |= over.astype(np.uint64) << np.uint64(b)
    return out.view(np.int64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, words: int = 4, column: str = "fp") -> DataFrame:
    """Add the fingerprint of `text` as a long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(t, words)) for t in texts], dtype="int64")

    return docs.withColumn(column, of("text"))


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: pseudo-random, the same in every run."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", 42) for i in range(n)], np.uint64)


def with_pivot_table(fingerprints: DataFrame, n: int = PIVOTS) -> DataFrame:
    """`fp` with its table of distances to the pivots, eight of one byte in each of the columns t0, t1, ..."""
    pivots = [signed(int(p)) for p in pivot_fingerprints(n)]
    packs = [pivots[k : k + 8] for k in range(0, n, 8)]
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long")
    packed_columns = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(distance(p), 8 * i) for i, p in enumerate(pack)]) for pack in packs]
    return fingerprints.select("fp", *[c.alias(f"t{k}") for k, c in enumerate(packed_columns)])


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """A mask for each choice of blocks that must agree when at most `radius` of them can hold a differing bit."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    part = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - radius)]


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """Spanning links (a, b) of all pairs of the distinct longs `fp` within `radius` bits of each other.

    The pivot tables are computed once, stored with the fingerprints, and travel with them to every group.
    """
    masks = block_masks(blocks or radius + 2, radius)
    tables = stored(with_pivot_table(fingerprints), "pivots")
    columns = tables.columns
    keyed = tables.select(
        *columns, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(masks)])).alias("key")
    ).select(*columns, "key.k", "key.v")
    counts = keyed.groupBy("k", "v").count().where("count > 1").select("k", "v", F.ceil(F.col("count") / chunk).cast("int").alias("c"))
    met = keyed.join(counts, ["k", "v"])
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    dealt = met.withColumn("own", own).select(
        *columns, "k", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))).alias("ij")
    ).select(*columns, F.xxhash64("k", "v", "ij.i", "ij.j").alias("g"))

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        fp, g = rows["fp"].to_numpy().view(np.uint64), rows["g"].to_numpy()
        distance = np.ascontiguousarray(rows[columns[1:]].to_numpy(np.int64)).view(np.int8)

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = np.abs(distance[i] - distance[j]).max(axis=1) <= radius
            ok[ok] = np.bitwise_count(fp[i[ok]] ^ fp[j[ok]]) <= radius
            return ok

        pairs = np.array(spanning_links(fp, g, linked), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[pairs[:, 0]].view(np.int64), "b": fp[pairs[:, 1]].view(np.int64)})

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return by_runs(batches, "g", found)

    return dealt.repartition("g").sortWithinPartitions("g", "fp").mapInPandas(lean(links), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for each row of `docs`."""
    prints = stored(with_fingerprint(docs, words).select("doc_id", "fp"), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(fingerprint_links(classes.select("fp"), radius))
    named = parts.join(classes, parts["node"] == classes["fp"]).select("fp", "component", "least")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(smallest, "component").select("fp", "component_id")
    of_class = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(of_class, "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_table(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """doc_id, h (hash of the text), class of the set of shingles (48 bits each), and once a task for each class that may have a partner its set.

    `fp` is the text's SimHash. size, signature and tokens (packed, in the order of the hashes) are null otherwise. Texts without words have class 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rolling, seen = Reader(), Rolling(), set()
        for batch in batches:
            for slab in slabs(batch.column("text"), reader):
                shingle, text, _ = slab.windows(rolling, words)
                prints = fingerprints_of(shingle, text, slab.rows[1] - slab.rows[0])
                key = text.astype(np.uint64) << np.uint64(48) | shingle >> np.uint64(16)
                key.sort()
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                of, token = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
                own = np.diff(np.r_[first, len(of)])
                n = slab.rows[1] - slab.rows[0]
                cls, size, bits, sets = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((WIDE, n), np.int64), [None] * n
                if len(first):
                    spot = of[first]
                    cls[spot] = mixed(np.add.reduceat(mixed(token + np.uint64(1)), first) + own.astype(np.uint64)).view(np.int64)
                    size[spot], bits[:, spot] = own, signatures(token, first)
                    for k, f, m in zip(spot.tolist(), first.tolist(), own.tolist(), strict=True):
                        if ceil(threshold * (m + 1) - 1e-9) <= m and cls[k] not in seen:
                            seen.add(int(cls[k]))
                            sets[k] = packed(token[f : f + m])
                mask = np.array([x is None for x in sets], bool)
                at = slice(*slab.rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at], batch.column("h")[at], pa.array(cls), pa.array(prints), pa.array(size.astype(np.int32), mask=mask), *[pa.array(b, mask=mask) for b in bits], pa.array(sets, pa.binary())], ["doc_id", "h", "class", "fp", "size", *BITS, "tokens"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(cut), "doc_id long, h long, class long, fp long, size int" + "".join(f", {b} long" for b in BITS) + ", tokens binary")


def near_by_fingerprint(shingled: DataFrame, threshold: float, radius: int = RADIUS) -> DataFrame:
    """Stored links (a, b) of the classes of `shingle_table` by their fingerprints, each verified on the whole sets.

    Classes of one fingerprint meet their smallest class, and the smallest classes of two fingerprints meet where the pivot
    tables and the distance leave a link within `radius` bits.
    """
    own = stored(shingled.where("tokens is not null").groupBy("class").agg(F.min("fp").alias("fp")), "prints")
    heads = stored(own.groupBy("fp").agg(F.min("class").alias("head")), "heads")
    links = fingerprint_links(heads.select("fp"), radius)
    of_a, of_b = (heads.select(F.col("fp").alias(f), F.col("head").alias(c)) for f, c in (("fa", "x"), ("fb", "y")))
    between = links.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(of_a, "fa").join(of_b, "fb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = own.join(heads, "fp").where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    pairs = stored(between.union(within).distinct(), "near")
    sets = stored(sets_among(shingled, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()), "sets")
    out = stored(verified(pairs.withColumn("at", F.lit(None).cast("int")), sets, threshold), "links")
    discard(own, heads, pairs, sets)
    return out


def similar_texts(shingled: DataFrame, threshold: float = STAGE_THRESHOLD) -> DataFrame:
    """(node, component) of the classes of `shingle_table` that verified pairs link to another one: by SimHash first, then all that SimHash is too far from."""

    near = near_by_fingerprint(shingled, threshold)
    return linked_classes(shingled.sparkSession, prefix_candidates(shingled, threshold, ROUNDS), lambda wanted: sets_among(shingled, wanted), threshold, known=near)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = STAGE_WORDS, threshold: float = STAGE_THRESHOLD) -> DataFrame:
    """Pipeline stage: one document of each group stays, that with the smallest doc_id (then the smallest text hash).

    Groups are linked by every pair whose shingle sets have a Jaccard similarity of `threshold`. SimHash with pivot tables
    links what is within RADIUS bits, verified on the sets. A fingerprint distance only estimates the similarity (9.5 bits on
    average at 0.8, where unlike texts come near too, and no block key is selective), so an exact check follows: the join of
    `similarity` (prefixes, filters, whole sets) over the pairs that SimHash has not connected.
    Documents without words (nothing to compare, null texts among them) all stay; a null doc_id comes last; repeated rows
    leave one; an empty table stays empty.
    """
    shingled = stored(shingle_table(docs.select("doc_id", "text"), words, threshold), "shingled")
    classes = shingled.where("class <> 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("first"))
    parts = similar_texts(shingled, threshold)
    grouped = classes.join(parts, classes["class"] == parts["node"], "left").select(F.coalesce("component", "class").alias("part"), "first")
    keep = stored(grouped.groupBy("part").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h")), "keep")
    discard(shingled, parts)
    worded = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    hashed = docs.withColumn("_text_h", F.xxhash64("text"))
    kept = hashed.where(worded).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_h") == F.col("_h"))).select(*docs.columns)
    # equal rows of equal id and text: one stays; their number is small, so only they are gathered
    kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(~worded))
