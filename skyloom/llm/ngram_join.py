"""Operator 11: exact Jaccard join of n-gram sets, candidates filtered under several global token orders.

A document's set holds its distinct word n-grams. Every order sorts the n-grams of the corpus by rarity class first and by a
hash of its own inside a class, so prefixes hold rare n-grams whatever the order. Two sets that reach the threshold share an
n-gram of their prefixes under every order; a pair becomes a candidate only if it does so under all of them, and only
such pairs are verified on the whole sets.

Before that, a set is out of the join if as many of its n-grams as its prefix has are in no other set: what it can lack from
a partner is one fewer. A sample of twice the prefix is counted for this, once over all sets and once more over those left.

Groups of near copies would give all their pairs. So sets that share their least n-gram under some hash are first
verified against a few representatives of these keys, and what is connected by then is one part. Under an
order, an n-gram asks for nothing while its sets are all of one part; otherwise the sets outside the part that most of its
sets have meet the others, in groups of bounded size. Groups in which few pairs survive the filters give these pairs; a
crowd, in which most do, is verified where it meets and gives only links that join two parts.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; texts of
fewer words than an n-gram are one n-gram; equal sets are one class and always linked; repeated rows keep their
rows; a null doc_id keeps its row and never is a component's smallest id unless nothing else is in it; an empty table
gives an empty result; extra columns are ignored by the query. N-grams are told apart by 48-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import by_runs, discard, lean, pick, small, stored, table
from skyloom.llm.components import connected_components
from skyloom.llm.similarity import BITS, BLOCK, CHUNK, DENSE, LARGE, LARGE_WORDS, likely, packed, signatures, spanning
from skyloom.llm.words import Reader, Rolling, Slab, mixed, slabs

#: Words of an n-gram, and the least Jaccard similarity of a link in percent.
WORDS, PERCENT = 3, 90
#: Global token orders; hash keys of a set under which it meets representatives, and representatives of a key.
ORDERS, KEYS, REPRESENTATIVES = 3, 4, 4
#: Counters of n-grams by hash, from which the rarity classes come: a fixed size, whatever the corpus.
BUCKETS = 1 << 17
#: N-grams of a set that are counted to rule it out, as a multiple of its prefix, and how often that is done.
SAMPLE, EXCLUSIONS = 2, 2
TOKEN_BITS, ORDER_BITS, CLASSES = 48, 44, 64


def sets_of_slab(slab: Slab, rolling: Rolling, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and token of each distinct n-gram of the texts of a slab, by text and token."""
    shingle, text, _ = slab.windows(rolling, words)
    key = text.astype(np.uint64) << np.uint64(TOKEN_BITS) | shingle >> np.uint64(64 - TOKEN_BITS)
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> np.uint64(TOKEN_BITS)).astype(np.int64), key & np.uint64((1 << TOKEN_BITS) - 1)


def set_classes(token: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each set (sets begin at `first`), the same for equal ones."""
    return mixed(np.add.reduceat(mixed(token + np.uint64(1)), first) + size.astype(np.uint64)).view(np.int64)


def bucket_of(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64(BUCKETS - 1)).astype(np.int64)


def rarity_classes(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """A class for each bucket of n-grams, 0 up to the mean count and one more for each doubling beyond, from all documents.

    Every task counts into a fixed number of buckets; the driver gets one sum for each of them, never an n-gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rolling, total = Reader(), Rolling(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for slab in slabs(batch.column("text"), reader):
                total += np.bincount(bucket_of(sets_of_slab(slab, rolling, words)[1]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(lean(count, at_once=False), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    mean = max(1.0, total.sum() / BUCKETS)
    return np.clip(np.floor(np.log2(np.maximum(total, 1) / mean)), 0, CLASSES - 1).astype(np.uint8)


def prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    """N-grams of the prefix; 0 for sets so small that only an equal one reaches the threshold."""
    k = size - -(-percent * size // 100) + 1
    return np.where(-(-percent * (size + 1) // 100) > size, 0, k)


def wide_signatures(token: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    """A parity signature of 64 * LARGE_WORDS bits for each large set."""
    out: list[bytes | None] = [None] * len(size)
    large = np.flatnonzero(size > LARGE)
    bits = 64 * LARGE_WORDS
    place = (token >> np.uint64(8)).astype(np.int64) % bits
    begin = np.cumsum(size) - size
    for at in range(0, len(large), 256):
        part = large[at : at + 256]
        held = np.concatenate([place[begin[k] : begin[k] + size[k]] + i * bits for i, k in enumerate(part.tolist())])
        odd = np.bincount(held, minlength=len(part) * bits).reshape(-1, bits) & 1
        for k, row in zip(part.tolist(), np.packbits(odd.astype(np.uint8), axis=1), strict=True):
            out[k] = row.tobytes()
    return out


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.view(np.int64)))


def order_keys(of: np.ndarray, token: np.ndarray, rarity: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of the texts `of` as (text, rarity class, hash) in one number each, sorted: the order's sequence text by text."""
    top = of.astype(np.uint64) << np.uint64(TOKEN_BITS + 2) | rarity[bucket_of(token)].astype(np.uint64) << np.uint64(ORDER_BITS)
    key = top | mixed(token * np.uint64(2 * order + 3) + np.uint64(order)) >> np.uint64(64 - ORDER_BITS)
    key.sort()
    return key


def in_order(key: np.ndarray) -> np.ndarray:
    return key & np.uint64((1 << TOKEN_BITS + 2) - 1)


def sampled(docs: DataFrame, rarity: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, class, n and prefix (its size) for each row, and once a task for each class the first n-grams under order 0, SAMPLE prefixes of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rolling, seen = Reader(), Rolling(), set()
        for batch in batches:
            for slab in slabs(batch.column("text"), reader):
                of, token = sets_of_slab(slab, rolling, words)
                rows = slab.rows[1] - slab.rows[0]
                n = np.bincount(of, minlength=rows)
                full = np.flatnonzero(n)
                size = n[full]
                first = np.cumsum(size) - size
                cls, prefix, taken = (np.zeros(rows, np.int64) for _ in range(3))
                if len(full):
                    cls[full] = set_classes(token, first, size)
                    prefix[full] = prefix_sizes(size, percent)
                    for i in full[prefix[full] > 0].tolist():
                        if (own := int(cls[i])) not in seen:
                            seen.add(own)
                            taken[i] = min(n[i], SAMPLE * prefix[i])
                held = taken[of] > 0
                of, token = of[held], token[held]
                size = np.where(taken > 0, n, 0)
                place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                head = in_order(order_keys(of, token, rarity, 0)[place < taken[of]])
                columns = [batch.column("doc_id")[slice(*slab.rows)], pa.array(cls), pa.array(n.astype(np.int32)), pa.array(prefix.astype(np.int32)), lists(head, taken)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class", "n", "prefix", "head"])

    return docs.select("doc_id", "text").mapInArrow(lean(cut, at_once=False), "doc_id long, class long, n int, prefix int, head array<long>")


def linkable(cut: DataFrame) -> DataFrame:
    """class and doc_id (one of its documents) of the sets that may have an unequal partner: too few of their n-grams are theirs alone."""
    heads = cut.where(F.size("head") > 0)
    left = None
    for _ in range(EXCLUSIONS):
        rows = (heads if left is None else heads.join(small(left.select("class"), 2_000_000), "class", "left_semi")).select("class", "prefix", F.explode("head").alias("token"))
        # copies of a class in several tasks are one class: its n-grams are its own while the least and the largest class are the same
        alone = rows.groupBy("token").agg(F.min("class").alias("class"), F.max("class").alias("other")).where("class = other").groupBy("class").agg(F.count("*").alias("own"))
        every = heads.groupBy("class").agg(F.first("prefix").alias("prefix"), F.min("doc_id").alias("doc_id")) if left is None else left
        again = stored(every.join(alone, "class", "left").where(F.coalesce("own", F.lit(0)) < F.col("prefix")).select("class", "prefix", "doc_id"), "linkable")
        discard(*([left] if left is not None else []))
        left = again
    return left


def described(docs: DataFrame, wanted: DataFrame, rarity: np.ndarray, words: int, percent: int) -> DataFrame:
    """One row for each wanted class, from one of its documents, which is read again: n, a signature of 256 bits, a wide one of large sets, the least hashes `m`, the prefixes `p0`, `p1`, ... and all tokens."""
    orders = [f"p{k}" for k in range(ORDERS)]
    ids = small(wanted.select(F.col("doc_id").alias("_id")).distinct(), 2_000_000)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rolling = Reader(), Rolling()
        for batch in batches:
            for slab in slabs(batch.column("text"), reader):
                of, token = sets_of_slab(slab, rolling, words)
                n = np.bincount(of, minlength=slab.rows[1] - slab.rows[0])
                taken = np.where(n > 0, prefix_sizes(n, percent), 0)
                held = taken[of] > 0
                of, token = of[held], token[held]
                if not len(of):
                    continue
                size, taken = n[taken > 0], taken[taken > 0]
                of = np.repeat(np.arange(len(size)), size)
                begin = np.cumsum(size) - size
                place = np.arange(len(token)) - np.repeat(begin, size)
                least = np.stack([np.minimum.reduceat(mixed(token + np.uint64((k + 1) << 52)), begin) for k in range(KEYS)], axis=1)
                prefixes = [in_order(order_keys(of, token, rarity, k)[place < taken[of]]) for k in range(ORDERS)]
                sets = [token[b : b + z].tobytes() for b, z in zip(begin.tolist(), size.tolist(), strict=True)]
                columns = [pa.array(set_classes(token, begin, size)), pa.array(size.astype(np.int32)), *[pa.array(x) for x in signatures(token, begin)], pa.array(wide_signatures(token, size), pa.binary())]
                columns += [lists(least.ravel(), np.full(len(size), KEYS)), *[lists(p, taken) for p in prefixes], pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["class", "n", *BITS, "wide", "m", *orders, "tokens"])

    schema = "class long, n int" + "".join(f", {b} long" for b in BITS) + ", wide binary, m array<long>" + "".join(f", {p} array<long>" for p in orders) + ", tokens binary"
    found = texts.mapInArrow(lean(cut, at_once=False), schema).join(small(wanted.select("class"), 2_000_000), "class", "left_semi")
    return found.dropDuplicates(["class"])


def needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """N-grams that two sets of these sizes must share."""
    return F.ceil(percent * (n_a.cast("long") + n_b) / (100 + percent))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and 256-bit signatures of the rows `a` and `b` leave a link possible."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in BITS])
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (differing <= n_a + n_b - 2 * needed(n_a, n_b, percent))


def representative_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the representatives of the hash keys that it shares with others, where a link is possible.

    A representative is the least class under a salted hash, so it comes from a partial aggregate: no key is gathered.
    """
    own = ["class", "n", *BITS]
    keyed = classes.select(*own, F.posexplode("m").alias("k", "v"))
    salted = [F.min(F.struct(F.xxhash64(F.lit(s), "class").alias("h"), *own)).alias(f"r{s}") for s in range(REPRESENTATIVES)]
    heads = keyed.groupBy("k", "v").agg(F.count("*").alias("rows"), *salted).where("rows > 1").drop("rows")
    met = keyed.join(heads, ["k", "v"]).select(F.struct(*own).alias("x"), F.explode(F.array(*[f"r{s}" for s in range(REPRESENTATIVES)])).alias("y"))
    return met.where((F.col("x.class") != F.col("y.class")) & may_link("x", "y", percent)).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def dealt_groups(nodes: DataFrame, order: int) -> DataFrame:
    """g, own, same, class, part, shape (n << 32 | place) and signature: rows of prefix n-grams of several parts, dealt out as groups of bounded size.

    An n-gram of at most CHUNK sets is one group. Of others the sets outside the part that most of them have are cut into
    chunks, and meet each other and the chunks of that part chunk by chunk: there only rows of different `own` are a pair, unless `same`.
    """
    rows = nodes.select("class", "part", F.posexplode(f"p{order}").alias("place", "token"))
    sizes = rows.groupBy("token", "part").count().groupBy("token").agg(F.count("*").alias("parts"), F.sum("count").alias("sets"), F.max(F.struct("count", "part")).alias("most"))
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    few = F.col("sets") <= CHUNK
    inner, outer = F.when(few, 0).otherwise(chunks(F.col("most.count"))), F.when(few, 1).otherwise(chunks(F.col("sets") - F.col("most.count")))
    split = stored(sizes.where("parts > 1").select("token", F.col("most.part").alias("main"), inner.alias("inner"), outer.alias("outer")), "split")
    known = rows.join(small(split, 2_000_000), "token").join(nodes.select("class", "n", *BITS), "class")
    within = (F.col("part") == F.col("main")) & (F.col("inner") > 0)
    number = F.xxhash64("class", "token")
    own = F.when(within, F.col("outer") + F.pmod(number, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(number, F.col("outer"))).cast("int")
    last = F.when(within, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    met = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
    shape = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))
    spread = known.withColumn("own", own).select("token", "own", "class", "part", shape.alias("shape"), *BITS, F.explode(met).alias("ij"))
    return spread.select(F.xxhash64("token", "ij.i", "ij.j").alias("g"), "own", (F.col("ij.i") == F.col("ij.j")).alias("same"), "class", "part", "shape", *BITS)


def surviving(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of whole groups, by g and shape, that pass size, place and signature filters; of groups in which too many do, those that have one: (a, null, g, part)."""
    of, part, g, own, same, shape = (rows[c].to_numpy() for c in ("class", "part", "g", "own", "same", "shape"))
    bits = [rows[b].to_numpy().view(np.uint64) for b in BITS]
    run = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
    held = np.bincount(run)
    n, place = shape >> 32, shape & 0xFFFFFFFF
    stop = np.searchsorted(run << 32 | n, run << 32 | 100 * n // percent, "right")
    partners = stop - np.arange(len(of)) - 1
    ends, hits, survivors, met, at = np.cumsum(partners), [], np.zeros(len(held), np.int64), np.zeros(len(of), bool), 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        m = partners[at:to]
        i = np.repeat(np.arange(at, to), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        ok = (part[i] != part[j]) & (same[i] | (own[i] != own[j]))
        i, j = i[ok], j[ok]
        want = -(-percent * (n[i] + n[j]) // (100 + percent))
        # what both share stands before the n-gram in both, or is it, or stands after it in both
        ok = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= want
        i, j, room = i[ok], j[ok], (n[i] + n[j] - 2 * want)[ok]
        ok = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits) <= room
        i, j = i[ok], j[ok]
        survivors += np.bincount(run[i], minlength=len(survivors))
        met[i] = met[j] = True
        keep = survivors[run[i]] <= DENSE * held[run[i]]
        hits.append((i[keep], j[keep]))
        at = to
    dense = survivors > DENSE * held
    i, j = (np.concatenate(x) for x in zip(*hits, strict=True))
    keep = ~dense[run[i]]
    a, b = of[i[keep]], of[j[keep]]
    crowd = np.flatnonzero(met & dense[run])
    none = np.zeros(len(crowd), np.int64)
    return pd.DataFrame({
        "a": np.r_[np.minimum(a, b), of[crowd]], "b": pd.arrays.IntegerArray(np.r_[np.maximum(a, b), none], np.r_[np.zeros(len(a), bool), np.ones(len(crowd), bool)]),
        "g": np.r_[np.zeros(len(a), np.int64), g[crowd]], "part": np.r_[np.zeros(len(a), np.int64), part[crowd]],
    })


def candidates(nodes: DataFrame, order: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored (a, b) of different parts that share a prefix n-gram under one order and pass the filters, and stored crowds (class, part, g): groups in which too many pairs do."""

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return by_runs(batches, "g", lambda rows: surviving(rows, percent))

    dealt = dealt_groups(nodes, order).repartition("g").sortWithinPartitions("g", "shape", "class")
    found = stored(dealt.mapInPandas(lean(met, at_once=False), "a long, b long, g long, part long"), "met")
    pairs = stored(found.where("b is not null").select("a", "b").distinct(), f"order{order}")
    crowd = found.where("b is null").select(F.col("a").alias("class"), "part", "g")
    # groups of the same sets are one
    alike = crowd.groupBy("g").agg(F.count("*").alias("sets"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum")).groupBy("sets", "sum").agg(F.min("g").alias("g"))
    crowds = stored(crowd.join(alike.select("g"), "g", "left_semi"), "crowds")
    discard(found)
    return pairs, crowds


def crowd_links(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links that join the parts of each crowd (class, part, g) as far as its pairs do; sets are compared by 40 bits of their n-grams."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        of, g, part = (rows[c].to_numpy() for c in ("class", "g", "part"))
        tokens = [packed(np.frombuffer(x, np.uint64)) for x in rows["tokens"]]
        edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]).tolist()
        links = [(lo + x, lo + y) for lo, hi in zip(edges[:-1], edges[1:], strict=True) for x, y in spanning(tokens[lo:hi], percent / 100, part[lo:hi])]
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": of[ends[:, 0]], "b": of[ends[:, 1]]})

    rows = crowds.join(sets, "class").select("g", "class", "part", "tokens")
    return rows.repartition("g").sortWithinPartitions("g").mapInPandas(lean(lambda batches: by_runs(batches, "g", found), at_once=False), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            both = np.sort(np.frombuffer(x + y, np.uint64))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            out[i] = 100 * common >= percent * (len(both) - common)
        return pd.Series(out)

    one, two = (sets.select(F.col("class").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").where(linked("tokens_a", "tokens_b")).select("a", "b")


def linked_parts(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the described classes that some chain of links joins to another class."""
    sets = classes.select("class", "tokens")

    def likely_pairs(pairs: DataFrame) -> DataFrame:
        return stored(likely(pairs, classes.select("class", "n", "wide"), percent / 100), "likely")

    near = likely_pairs(representative_pairs(classes, percent))
    links = stored(verified(near, sets, percent), "links")
    parts = stored(connected_components(links), "parts")
    discard(near)

    nodes = stored(classes.drop("wide", "m", "tokens").join(parts, classes["class"] == parts["node"], "left").withColumn("part", F.coalesce("component", "class")).drop("node", "component"), "nodes")
    pairs, joined = None, []
    for order in range(ORDERS):
        ends = None if pairs is None else stored(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "ends")
        found, crowds = candidates(nodes if ends is None else nodes.join(small(ends, 2_000_000), "class", "left_semi"), order, percent)
        joined.append(stored(crowd_links(crowds, sets, percent), "links"))
        discard(crowds, *([ends] if ends is not None else []))
        # a pair stays only while every order so far proposes it: what meets in a crowd is settled there
        both = found if pairs is None else stored(pairs.join(found, ["a", "b"], "left_semi"), "both")
        discard(*([pairs, found] if pairs is not None else []))
        pairs = both
    left = likely_pairs(pairs)
    discard(nodes, pairs)
    every = stored(reduce(DataFrame.union, [links, *joined, verified(left, sets, percent)]), "links")
    final = stored(connected_components(every), "parts")
    discard(links, parts, every, left, *joined)
    return final


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class (0: empty set) and component_id (smallest doc_id reachable over links) for each row of `docs`."""
    rarity = rarity_classes(docs, words)
    cut = stored(sampled(docs, rarity, words, percent), "sampled")
    members = stored(cut.select("doc_id", "class", "n"), "members")
    wanted = linkable(cut)
    classes = stored(described(docs, wanted, rarity, words, percent), "described")
    discard(cut, wanted)
    parts = linked_parts(classes, percent)
    discard(classes)
    least = members.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    parted = least.join(parts, least["class"] == parts["node"], "left").select("class", "least", F.coalesce("component", "class").alias("part"))
    smallest = parted.groupBy("part").agg(F.min("least").alias("component_id"))
    of_class = parted.join(smallest, "part").select("class", "component_id")
    named = members.where("class <> 0").join(of_class, "class").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class", "component_id")
    return named.unionByName(members.where("class = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class", F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(pick(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), n AS (
  SELECT r, doc_id, len(sh) AS n FROM s
), e AS (
  SELECT r, unnest(sh) AS g FROM s
), p AS (
  SELECT x.r AS a, y.r AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r
), l AS (
  SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT r AS a, r AS b FROM n UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least.component_id
FROM n JOIN (SELECT reach.a, min(m.doc_id) AS component_id FROM reach JOIN n m ON m.r = reach.b GROUP BY reach.a) least ON least.a = n.r
"""
