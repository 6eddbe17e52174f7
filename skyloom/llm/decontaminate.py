"""Operator 1: benchmark decontamination with a distributed positional inverted index (built-in functions only).

1. The words of the test set are counted over all training documents (combined on the map side).
2. For each window of `window` consecutive test words the rarest terms are its anchors (two for phrases, three for proximity). Windows that share their
   rarest term share one anchor, so an item of 50 words has a handful of anchors instead of 41 windows.
3. Postings (term, document, position, the words around) of the anchor terms are stored in the shared folder.
4. The lists of rarest terms give alignments of item and document; they are intersected with the offset-adjusted lists
   of the second rarest terms. What is left is compared word by word with the stored context: a run of `window` equal
   words around the anchor is an exact phrase match. Alignments at which only `near` words of a window agree are proximity matches.

The test set is the small side: it is broadcast after a count, and joined by shuffle where it is larger. No document is
shuffled; postings exist for anchor terms only, and each alignment costs one row however long the passage is.

Defined results: a null or empty text has no words and is clean; null or empty benchmark texts make no window; an item
shorter than the window is one window; a null item_id marks words as hit but is not listed; items that share an id
count once; documents that are equal in id and text give equal rows; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import ALNUM_GAP, alnum_words, ascii_lower, discard, pick, row_key, small, stored, table

WINDOW, NEAR = 10, 8


def raw_words():
    """Words with their places; the first and last may be empty, which keeps the distances between words."""
    return F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), ALNUM_GAP)


def ranked_terms(items: DataFrame, counts: DataFrame, window: int, most: int) -> DataFrame:
    """The `most` rarest terms (place, term, rank r from 1) of every window (item, start)."""
    placed = items.select("item", "item_id", "n", F.posexplode("words").alias("place", "term")).join(small(counts), "term", "left")
    within = F.sequence(F.greatest(F.lit(0), F.col("place") - window + 1), F.greatest(F.lit(0), F.least("place", F.col("n") - window)))
    spots = placed.select("item", "item_id", "n", "place", "term", F.coalesce("count", F.lit(0)).alias("count"), F.explode(within).alias("start"))
    order = Window.partitionBy("item", "start").orderBy("count", "place")
    return spots.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)


def with_words(spots: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Distinct anchors with the words of the item around them."""
    reach = window - 1
    around = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.get("words", F.col("place") + k))
    once = spots.select("item", "item_id", "place", "term").distinct().join(items.select("item", "n", "words"), "item")
    return once.select("item", "item_id", "place", F.xxhash64("item", "place").alias("anchor"), "term", F.least("n", F.lit(window)).alias("need"), around.alias("want"))


def anchors(items: DataFrame, ranked: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """First anchors (anchor, term, item words around it) and second ones (anchor, term, distance from the first)."""
    pairs = ranked.where("r <= 2").groupBy("item", "start").agg(
        F.max(F.when(F.col("r") == 1, F.struct("place", "term"))).alias("one"), F.max(F.when(F.col("r") == 2, F.struct("place", "term"))).alias("two")
    )
    apart = F.coalesce(F.col("two.place") - F.col("one.place"), F.lit(0))
    second = pairs.select(F.xxhash64("item", "one.place").alias("anchor"), F.coalesce("two.term", "one.term").alias("term"), apart.alias("apart")).distinct()
    return with_words(ranked.where("r = 1"), items, window), second


def postings(docs: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """Stored posting lists (term, doc, pos, context) of `terms`.

    The context is a plain slice, cut off at the ends of the text: it starts with the word min(pos, window - 1) places
    before. A lambda here would leave generated code and copy the words of a document for each of its postings.
    """
    reach = window - 1
    words = docs.select(row_key().alias("doc"), raw_words().alias("words"))
    listed = words.select("doc", "words", F.posexplode("words").alias("pos", "term")).join(small(terms), "term")
    around = F.slice("words", F.greatest(F.col("pos") + 1 - reach, F.lit(1)), F.least("pos", F.lit(reach)) + window)
    return stored(listed.select("term", "doc", "pos", around.alias("context")), "postings")


def item_table(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    return stored(items.select("item_id", F.xxhash64("item_id", "words").alias("item"), "words", F.size("words").alias("n")), "items")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How often each word of the test set stands in the documents."""
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    return stored(docs.select(F.explode(raw_words()).alias("term")).join(small(vocabulary), "term", "left_semi").groupBy("term").count(), "counts")


def agreement(window: int):
    """Which of the words around an anchor are equal in the document and in the item."""
    lead = F.least("pos", F.lit(window - 1)) - (window - 1)
    return F.transform("want", lambda w, i: F.coalesce(w == F.get("context", i + lead), F.lit(False)))


def run_around(window: int):
    """Equal words that follow one another before and after the anchor."""
    reach = window - 1
    left, right = F.array_position(F.reverse(F.slice("equal", 1, reach)), False), F.array_position(F.slice("equal", reach + 2, reach), False)
    return F.when(left == 0, reach).otherwise(left - 1).cast("int"), F.when(right == 0, reach).otherwise(right - 1).cast("int")


@dataclass(frozen=True)
class Index:
    """The positional index of a corpus for a test set: items, the ranked terms of their windows, and the stored posting lists."""

    items: DataFrame
    ranked: DataFrame
    lists: DataFrame
    window: int
    near: int

    def discard(self) -> None:
        discard(self.items, self.ranked, self.lists)


def build(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR) -> Index:
    """Postings of the window - near + 1 rarest terms of every window: of words that agree at `near` places one is among them."""
    items = item_table(benchmark)
    ranked = stored(ranked_terms(items, term_counts(docs, items), window, max(2, window - near + 1)), "ranked")
    return Index(items, ranked, postings(docs, ranked.select("term").distinct(), window), window, near)


def exact_matches(index: Index) -> DataFrame:
    """Exact phrase matches: doc, item_id, first and last word hit (places)."""
    first, second = (stored(x, "anchors") for x in anchors(index.items, index.ranked, index.window))
    found = index.lists.join(small(first), "term").select("doc", "anchor", "item_id", "pos", "context", "want", "need")
    other = index.lists.join(small(second), "term").select("doc", "anchor", (F.col("pos") - F.col("apart")).alias("pos"))
    both = found.join(other, ["doc", "anchor", "pos"], "left_semi").withColumn("equal", agreement(index.window))
    left, right = run_around(index.window)
    run = both.select("doc", "item_id", "need", "pos", left.alias("left"), right.alias("right")).where("left + right + 1 >= need")
    return run.select("doc", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"))


def near_matches(index: Index) -> DataFrame:
    """Alignments (doc, item_id, shift, best) at which `near` words of some window stand at their places, but no whole window does."""
    window, near = index.window, index.near
    every = stored(with_words(index.ranked, index.items, window), "anchors")
    met = index.lists.join(small(every), "term").withColumn("equal", agreement(window))
    left, right = run_around(window)
    # few words around most anchors agree at all; only the others are looked at window by window
    agreed = F.size(F.filter("equal", lambda e: e))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda s: F.size(F.filter(F.slice("equal", s, F.lit(window)), lambda e: e))))
    likely = met.where(agreed >= F.least("need", F.lit(near)))
    run = likely.select("doc", "item_id", (F.col("pos") - F.col("place")).alias("shift"), best.alias("best"), (left + right + 1 >= F.col("need")).alias("exact"), F.least("need", F.lit(near)).alias("least"))
    return run.groupBy("doc", "item_id", "shift").agg(F.max("best").alias("best"), F.max("exact").alias("exact"), F.max("least").alias("least")).where("not exact and best >= least").drop("exact", "least")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    return exact_matches(build(docs, benchmark, window, window - 1))


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    return near_matches(build(docs, benchmark, window, near))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of `docs`: its columns, n_words, n_hit, items and near_items (sorted ids as strings), the latter of proximity matches."""
    index = build(docs, benchmark, window)
    found = stored(exact_matches(index), "matches")
    near = near_matches(index).groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("near_items"))
    order = Window.partitionBy("doc").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.coalesce(before + 1, F.col("first"))) + 1)
    hits = found.select("doc", "first", "last").distinct().withColumn("new", new).groupBy("doc").agg(F.sum("new").alias("n_hit"))
    items = found.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per = stored(items.join(hits, "doc").join(near, "doc", "full"), "hits").select(F.col("doc").alias("_doc"), "n_hit", "items", "near_items")
    index.discard()
    none = F.array().cast("array<string>")
    keyed = docs.withColumn("_doc", row_key()).withColumn("n_words", F.size(alnum_words(F.col("text"))).cast("long"))
    return keyed.join(small(per), "_doc", "left").select(*docs.columns, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = contamination(docs, pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"), F.array_join("near_items", ",").alias("near_items"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of a test item go, whole or with most of its words at their places.

    Null and empty texts stay; null ids and repeated rows are judged by their text; an empty table stays empty.
    """
    index = build(docs.select("doc_id", "text"), pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    found = stored(exact_matches(index).select("doc").union(near_matches(index).select("doc")).distinct(), "hits")
    index.discard()
    return docs.withColumn("_doc", row_key()).join(small(found), F.col("_doc") == F.col("doc"), "left_anti").select(*docs.columns)


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, list_slice(words, s, s + least(len(words), 10) - 1) AS win, least(len(words), 10) AS n
  FROM b, unnest(generate_series(1, greatest(1, len(words) - 9))) AS g(s) WHERE len(words) > 0
), lens AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, s, lens.n, list_slice(words, s, s + lens.n - 1) AS win
  FROM w, lens, unnest(generate_series(1, len(words) - lens.n + 1)) AS g(s)
), hit AS (
  SELECT DISTINCT doc_id, item_id, s, dw.n FROM dw JOIN bw USING (win)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(s, s + n - 1)) AS g(p) GROUP BY doc_id
), it AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM hit GROUP BY doc_id
), d3 AS (
  -- where 8 of 10 words stand at their places, three of them follow one another
  SELECT doc_id, s, list_slice(words, s, s + 2) AS g FROM w, unnest(generate_series(1, len(words) - 2)) AS t(s)
), b3 AS (
  SELECT item_id, words, s, list_slice(words, s, s + 2) AS g FROM (SELECT DISTINCT * FROM b), unnest(generate_series(1, len(words) - 2)) AS t(s)
), al AS (
  SELECT DISTINCT doc_id, item_id, b3.words AS own, d3.s - b3.s AS shift FROM d3 JOIN b3 USING (g)
), eq AS (
  SELECT al.doc_id, item_id, len(own) AS n, list_transform(generate_series(1, len(own)), lambda k: CASE WHEN shift + k >= 1 AND w.words[shift + k] = own[k] THEN 1 ELSE 0 END) AS same FROM al JOIN w USING (doc_id)
), wi AS (
  SELECT doc_id, item_id, least(n, 10) AS need, list_max(list_transform(generate_series(1, greatest(1, n - 9)), lambda s: list_sum(list_slice(same, s, s + least(n, 10) - 1)))) AS best FROM eq
), ni AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS near FROM wi WHERE best < need AND best >= least(need, 8) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(len(near), 0) AS BIGINT) AS n_near, coalesce(array_to_string(near, ','), '') AS near_items
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
