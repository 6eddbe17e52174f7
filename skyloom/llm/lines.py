"""Operator 8: line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased, between ASCII white space). Lines with equal sets are one class. A line
goes if an earlier line (by doc_id, then line number) has a Jaccard similarity of `threshold` or more, verified on the
whole sets; a line stays if no earlier one does, whatever chains lead to it.

The join: every class orders its tokens by rarity, and only its first |x| - ceil(t|x|) + 1 tokens (prefix) are joined,
since two sets over the threshold share one of them. Pairs are cut by length, by place (what can still follow the shared
token) and by a 256-bit signature whose differing bits bound the differing tokens from below; see `similarity`.

Rarity: words are counted over all documents into 2**20 buckets by hash, summed in Spark; a bucket's count, on a scale of
255 steps, orders its words, and the hash decides between equal ones. Any fixed order gives the same links; the order
only decides how few pairs meet, and the table keeps its size however many words there are.

Texts are read twice: for the counts, and for a table of lines in which the first line of each class in a task carries
the class's set. All that follows reads that table.

Defined results: null and empty texts have no lines to remove; lines without words always stay; a null doc_id comes
last in the order; repeated rows (equal id and text) repeat their lines, of which the first stays; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import discard, lean, pick, release, small, stored, table
from skyloom.llm.similarity import BITS, ROUNDS, WIDE, WIDTH, crowd_counts, packed, prefix_candidates, prefix_length, sets_among, signatures, split_candidates, verified
from skyloom.llm.words import Reader, mixed, slabs

THRESHOLD = 0.8
#: Buckets of the word counts, and rows of the table that carries them.
BUCKETS, PARTS = 1 << 20, 64
#: Classes of a task whose sets have been given; beyond that some come twice, which the join allows.
REMEMBERED = 1 << 19


def rarity(docs: DataFrame) -> np.ndarray:
    """A byte for each bucket of word hashes: 0 for the rarest words, 255 for the most frequent."""
    width = BUCKETS // PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for slab in slabs(batch.column(0), reader, 4 << 20):
                total += np.bincount((slab.hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        if total.any():
            small_total = np.minimum(total, (1 << 32) - 1).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([part.tobytes() for part in small_total.reshape(PARTS, width)], pa.binary())], ["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals[part] = totals.get(part, 0) + np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
        steps = [np.minimum(255, 6 * np.log2(np.maximum(t, 1))).astype(np.uint8).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(steps, pa.binary())], ["part", "steps"])

    parts = docs.select("text").mapInArrow(lean(counted, at_once=False), "part int, counts binary").repartition("part").mapInArrow(lean(summed, at_once=False), "part int, steps binary")
    out = np.zeros((PARTS, width), np.uint8)
    for row in parts.collect():  # PARTS rows of a fixed size
        out[row["part"]] = np.frombuffer(row["steps"], np.uint8)
    return out.ravel()


def line_table(docs: DataFrame, ranks, threshold: float) -> DataFrame:
    """doc_id, row (hash of the text), line and class of each line with words.

    Once a task for each class that may have a partner: size, signature and tokens (packed, rarest first).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, steps, seen = Reader(), ranks.value.astype(np.uint64), set()
        for batch in batches:
            for slab in slabs(batch.column("text"), reader):
                if not len(slab.hashes):
                    continue
                at, text, number = slab.lines()
                # one number for line, rarity and 40 bits of the hash: sorting it orders the tokens of each line
                parts, sizes, of, spots = [], [], [], []
                for lo in range(0, int(at[-1]) + 1, 1 << 16):
                    a, b = np.searchsorted(at, [lo, lo + (1 << 16)])
                    h = slab.hashes[a:b]
                    key = (at[a:b] - lo).astype(np.uint64) << np.uint64(48) | steps[(h & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(40) | h >> np.uint64(24)
                    key.sort()
                    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                    line = (key >> np.uint64(48)).astype(np.int64)
                    token = key & np.uint64((1 << 40) - 1)
                    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
                    size = np.diff(np.r_[first, len(line)])
                    if len(first):
                        of.append(mixed(np.add.reduceat(mixed(token + np.uint64(1)), first) + size.astype(np.uint64)).view(np.int64))
                        spots.append(line[first] + lo)
                        parts.append((token, first, size))
                        sizes.append(size)
                cls, spot, size = np.concatenate(of), np.concatenate(spots), np.concatenate(sizes)
                fresh = np.zeros(len(cls), bool)
                due = np.flatnonzero(prefix_length(size, threshold) > 0)
                for k, c in zip(due.tolist(), cls[due].tolist(), strict=True):
                    if c not in seen:
                        fresh[k] = True
                        seen.add(c)
                if len(seen) > REMEMBERED:
                    seen = set()
                sets, done = [None] * len(cls), 0
                bits = np.zeros((WIDE, len(cls)), np.int64)
                for token, first, own in parts:
                    bits[:, done : done + len(first)] = signatures(token, first)
                    data, new = packed(token), np.flatnonzero(fresh[done : done + len(first)])
                    for k, f, n in zip(new.tolist(), first[new].tolist(), own[new].tolist(), strict=True):
                        sets[done + k] = data[f * WIDTH : (f + n) * WIDTH]
                    done += len(first)
                rows = pa.array(slab.rows[0] + text[spot])
                mask = ~fresh
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("row").take(rows), pa.array(number[spot].astype(np.int32)), pa.array(cls), pa.array(size.astype(np.int32), mask=mask), *[pa.array(b, mask=mask) for b in bits], pa.array(sets, pa.binary())],
                    ["doc_id", "row", "line", "class", "size", *BITS, "tokens"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(lean(cut, at_once=False), "doc_id long, row long, line int, class long, size int" + "".join(f", {b} long" for b in BITS) + ", tokens binary")


def place_of_line() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "line", "row")


def sortable(place: str) -> Column:
    """The place as a string in the same order."""
    number = lambda c: F.lpad(F.hex(F.coalesce(F.col(f"{place}.{c}").cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.when(F.col(f"{place}.z"), "1").otherwise("0"), number("doc_id"), number("line"), number("row"))


def class_links(lines: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(class, links, earlier): how many other classes reach the threshold, and whether one of them comes first; none for classes without.

    `lines` is deleted when the sets that are asked for have been taken from it.
    """
    spark = lines.sparkSession
    pairs, crowds, wanted = split_candidates(spark, prefix_candidates(lines, threshold, ROUNDS))
    sets = stored(sets_among(lines, wanted), "sets")
    discard(lines)
    release(spark)
    links = stored(verified(pairs, sets, threshold), "links")
    release(spark)
    ends = links.select(F.col("a").alias("class"), F.col("b").alias("other")).union(links.select("b", "a"))
    places = classes.join(ends.select("class").distinct(), "class", "left_semi").select("class", "first")
    placed = ends.join(places, "class").join(places.select(F.col("class").alias("other"), F.col("first").alias("other_first")), "other")
    single = placed.groupBy("class").agg(F.count("*").alias("n"), F.max(F.col("other_first") < F.col("first")).alias("earlier"))
    in_crowd = sets.join(crowds.select("class").distinct(), "class", "left_semi").join(classes.select("class", sortable("first").alias("first")), "class")
    both = single.union(crowd_counts(crowds, in_crowd, threshold))
    out = stored(both.groupBy("class").agg(F.sum("n").alias("links"), F.max("earlier").alias("earlier")), "class_links")
    discard(sets, links, wanted)
    return out


def marked_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, lines, links, classes) of documents with a line that goes or has a link or an equal one.

    `lines` are the numbers of those that go, sorted; `links` counts the other line sets that their lines reach, `classes` names the sets.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(rarity(docs))
    with_sets = stored(line_table(docs, ranks, threshold), "sets")
    ranks.unpersist()
    lines = stored(with_sets.select("doc_id", "row", "line", "class"), "lines")
    classes = stored(lines.groupBy("class").agg(F.min(place_of_line()).alias("first"), F.count("*").alias("n")), "classes")
    release(spark)
    links = class_links(with_sets, classes, threshold)
    many = stored(classes.join(links, "class", "left").where("n > 1 or links > 0").select("class", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("earlier", F.lit(False)).alias("earlier")), "many")
    goes = F.col("earlier") | (place_of_line() != F.col("first"))
    own = lines.join(small(many, 500_000), "class")
    per = own.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.when(goes, F.col("line")))).alias("lines"), F.collect_set(F.struct("class", "links")).alias("found"))
    out = stored(per.select("doc_id", "row", "lines", F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["links"]).alias("links"), F.array_sort(F.transform("found", lambda x: F.lower(F.lpad(F.hex(x["class"]), 16, "0")))).alias("classes")), "marked")
    discard(lines, classes, links, many)
    release(spark)
    return out


def joined_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` with the other columns of `gone`, whose `_id` and `_row` tell the document."""
    keyed = docs.withColumn("_text_row", F.xxhash64("text"))
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_row") == F.col("_row")), "left")


def with_removed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `removed` (numbers of the lines that go), `links` and `classes` of its lines."""
    found = marked_lines(docs.select("doc_id", "text"), threshold)
    gone = found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("lines").alias("_lines"), F.col("links").alias("_links"), F.col("classes").alias("_classes"))
    return joined_lines(docs, small(gone, items=F.size("_classes"))).select(
        *docs.columns, F.coalesce("_lines", F.array().cast("array<int>")).alias("removed"), F.coalesce("_links", F.lit(0)).alias("links"), F.coalesce("_classes", F.array().cast("array<string>")).alias("classes")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    # lines are counted before the join, so that no text moves with it
    return with_removed(docs.withColumn("n_lines", n_lines)).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"), F.col("links").alias("n_links"), F.array_join("classes", ",").alias("line_classes")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: removes later lines from the texts; a document whose every line with words went goes with them.

    Null texts and texts without words stay as they are, null ids come last in the order, an empty table stays empty.
    """
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_lines", i))
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    # only documents with a line that goes, and only its number: this side is small enough to be sent where the texts are for longer than that of `with_removed`
    found = marked_lines(docs.select("doc_id", "text")).where(F.size("lines") > 0).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("lines").alias("_lines"))
    kept = joined_lines(docs, small(found, 500_000, F.size("_lines"))).withColumn("_kept", text)
    return kept.where(F.col("_lines").isNull() | F.rlike("_kept", F.lit(r"[^\x20\x09-\x0D]"))).select(
        *[F.col("_kept").alias("text") if c == "text" else F.length("_kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    )
