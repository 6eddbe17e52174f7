"""Operators 11 to 13: plain loops, planted cases and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.llm import kmeans, ngram_join, periods

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
VEC = "vec_id long, embedding array<float>"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(seed: int, n: int, k: int = 500) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(k)}" for _ in range(n)]


def clashing(df):
    return df.select("*", F.lit("x").alias("words"), F.lit(1).alias("n"), F.lit(2).alias("class"), F.lit(3).alias("part"))


def on_disk(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# ---- operator 11


def shingle_set(text, n=3):
    w = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


def brute_components(rows):
    """(doc_id, size, smallest id reachable) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def joined(df):
    return sorted(((r[0], r[1], r[2]) for r in ngram_join.similar_documents(df.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(seed: int, n: int, copies: int, changed: int) -> list[str]:
    base, r = words_of(seed, n), random.Random(seed)
    out = [" ".join(base)]
    for c in range(copies):
        w = list(base)
        for k in range(r.randint(0, changed)):
            w[r.randrange(n)] = f"new{c}x{k}"
        out.append(" ".join(w))
    return out


def test_join_equals_all_pairs(spark):
    """Clouds around the threshold, a passage in most texts, exact copies, short texts and chains."""
    texts = near_copies(1, 120, 40, 6) + near_copies(2, 40, 15, 2) + near_copies(3, 400, 12, 18) + near_copies(4, 12, 10, 1)
    common = " ".join(words_of(9, 60))
    texts += [f"{common} " + " ".join(words_of(100 + i, 15 + i)) for i in range(25)]
    texts += [common] * 6 + [" ".join(words_of(200 + i, i)) for i in range(30)] + ["A b", "a B", "a b c", "a"]
    # a chain: each is near the next, the ends are not near each other
    base = words_of(7, 100)
    texts += [" ".join([f"c{k}" for k in range(i)] + base[i:]) for i in range(0, 30, 2)]
    rows = list(enumerate(texts, 1))
    random.Random(3).shuffle(rows)
    assert joined(spark.createDataFrame(rows, DOC).repartition(5)) == brute_components(rows)


def test_join_of_odd_rows(spark, tmp_path):
    long = " ".join(words_of(11, 30_000, 5_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "no id in this row at all"), (5, "no id in this row at all"), (6, long), (7, long + " one more word"), (8, "x"), (8, "x"), (9, "Ä \U0001f600 b"), (10, "ä \U0001f600 b"), (None, "alone without an id")]
    df = clashing(spark.createDataFrame(rows, DOC))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.query(spark, on_disk(tmp_path, documents=df)).collect()), key=str)
    assert got == brute_components(rows)
    assert ngram_join.similar_documents(spark.createDataFrame([], DOC)).count() == 0


def test_orders_share_no_first_token_but_rarity():
    """The orders put n-grams of one class differently, so that sharing a prefix under all of them says more than under one."""
    token = np.arange(1, 2000, dtype=np.uint64)
    keys = [ngram_join.mixed(token * np.uint64(2 * k + 3) + np.uint64(k)) for k in range(ngram_join.ORDERS)]
    heads = [set(np.argsort(k)[:200].tolist()) for k in keys]
    assert all(len(a & b) < 60 for i, a in enumerate(heads) for b in heads[:i])
    assert ngram_join.prefix_sizes(np.array([1, 8, 9, 10, 100]), 90).tolist() == [0, 0, 1, 2, 11]


def test_join_as_sql(spark):
    theirs = duckdb.sql(ngram_join.SQL.replace("FROM documents", f"FROM '{DIR}/documents.parquet'")).df()
    ours = ngram_join.query(spark, DIR).toPandas()
    assert sorted(map(tuple, ours[theirs.columns].to_numpy().tolist())) == sorted(map(tuple, theirs.to_numpy().tolist()))


# ---- operator 12


def brute_kmeans(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    centroids = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        centroids = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [x for (_, x), o in zip(kept, of, strict=True) if o == n]) else c for n, c in enumerate(centroids)]
    ends = [(i, *nearest(x)) for i, x in kept]
    per = Counter()
    for _, d, n in ends:
        per[n] += d
    return sorted((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in ends)


def clusters_of(spark, at):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(r) for r in kmeans.query(spark, at).select(*columns).collect())


def test_clusters_equal_plain_loops(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(i, (r.normal(0, 1 + i % 3, 64) * (1 + i % 4)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 64) for i in range(5)] + [(300, [float(i % 2) for i in range(64)]), (301, [-1.0] * 64), (5, [2.0] * 64)]
    odd = [(400, None), (401, [1.0] * 63), (402, [float("nan")] + [0.0] * 63), (403, [float("inf")] + [0.0] * 63), (404, [None] + [0.0] * 63), (405, [])]
    df = clashing(spark.createDataFrame(rows + odd, VEC)).withColumn("x", F.lit(1)).repartition(3)
    assert clusters_of(spark, on_disk(tmp_path, embeddings=df)) == brute_kmeans(rows + odd)


def test_clusters_of_few_and_no_vectors(spark, tmp_path):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters_of(spark, on_disk(tmp_path / "a", embeddings=spark.createDataFrame(few, VEC))) == brute_kmeans(few)
    assert clusters_of(spark, on_disk(tmp_path / "b", embeddings=spark.createDataFrame([], VEC))) == []
    far = [(1, [1e30] * 64), (2, [0.0] * 64), (None, [1.0] * 64)]
    got = clusters_of(spark, on_disk(tmp_path / "c", embeddings=spark.createDataFrame(far, VEC).where("vec_id is not null")))
    assert [g[0] for g in got] == [2]
    assert kmeans.query(spark, on_disk(tmp_path / "d", embeddings=spark.createDataFrame(far, VEC))).count() == 2


@pytest.mark.parametrize("spread", [0, 1, 5, 1000, 1 << 26])
def test_annulus_loses_no_nearest_and_no_tie(spread):
    r = np.random.default_rng(spread)
    x = r.integers(-spread, spread + 1, (300, 64))
    c = np.vstack([r.integers(-spread, spread + 1, (18, 64)), x[:2], x[:1]])
    number, d = kmeans.assigned(x, c)
    every = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x[:40]], object)
    assert [min((dist, k) for k, dist in enumerate(row)) for row in every.tolist()] == list(zip(d[:40].tolist(), number[:40].tolist(), strict=True))


def test_clusters_as_sql(spark):
    theirs = duckdb.sql(kmeans.sql().replace("FROM embeddings", f"FROM '{DIR}/embeddings.parquet'")).df()
    ours = kmeans.query(spark, DIR).toPandas()
    assert sorted(map(tuple, ours[theirs.columns].to_numpy().tolist())) == sorted(map(tuple, theirs.to_numpy().tolist()))


# ---- operator 13


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            s = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            if (size := i - s + p) >= max(12, 2 * p) and i > s:
                seg = w[s : s + size]
                if next(q for q in range(1, size + 1) if seg[q:] == seg[: size - q]) == p:
                    out.append((s, size, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    w = SPACE.findall(text or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(runs), *((None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])), digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def reports(df):
    return sorted((tuple(r) for r in periods.periodic_runs(df.select("doc_id", "text"), rewrite=True).collect()), key=str)


def random_text(r):
    k = r.choice([1, 2, 3, 5, 60])
    t = [f"w{r.randrange(k)}" for _ in range(r.randint(0, 80))]
    for _ in range(r.randint(0, 3)):
        p, at = r.randint(1, 14), r.randint(0, len(t))
        base = [f"w{r.randrange(k)}" for _ in range(p)]
        t[at:at] = [base[i % p] for i in range(r.randint(p, 5 * p + 3))]
    return "".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in t)


def test_runs_equal_plain_loops(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, random_text(r)) for i in range(600)]
    expected = sorted((brute_report(*row) for row in rows), key=str)
    assert sum(e[1] for e in expected) > 300 and sum(e[1] > 1 for e in expected) > 50
    assert reports(spark.createDataFrame(rows, DOC).repartition(3)) == expected


@pytest.mark.parametrize("block, chunk", [(16, 1), (64, 4), (1 << 20, 64)])
def test_runs_over_block_and_chunk_edges(block, chunk, monkeypatch):
    monkeypatch.setattr(periods, "BLOCK", block)
    monkeypatch.setattr(periods, "CHUNK", chunk)
    r = random.Random(block)
    for _ in range(150):
        texts = [random_text(r).split() for _ in range(r.randint(1, 4))]
        number = {x: i for i, x in enumerate(sorted({x for t in texts for x in t}))}
        w = np.array([number[x] for t in texts for x in t], np.uint64)
        got = periods.runs_of_texts(w, np.r_[0, np.cumsum([len(t) for t in texts])])
        assert [got.get(i, []) for i in range(len(texts))] == [brute_runs(t) for t in texts]


def test_runs_of_odd_rows(spark, tmp_path):
    twice = " ".join(words_of(4, 50)) + " "
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a " * 40), (5, "a " * 40), (5, "a " * 40), (6, "A a " * 5), (7, twice * 3), (8, "Ä x b " * 8), (10, "a " * 11), (11, "a " * 12), (12, "a b " * 6 + "c d e f g h " * 2)]
    df = clashing(spark.createDataFrame(rows, DOC))
    got = sorted((tuple(r) for r in periods.query(spark, on_disk(tmp_path, documents=df)).collect()), key=str)
    assert got == sorted((brute_report(*row) for row in rows), key=str)
    assert periods.periodic_runs(spark.createDataFrame([], DOC)).count() == 0


def test_runs_of_very_long_texts(spark):
    """Every period divides a run of one word: grid points within it are skipped, not extended."""
    rows = [(1, "x " * 60_000), (2, ("a b c d e f g " * 9_000) + " ".join(words_of(1, 3_000, 10**6)) + " tail" * 500)]
    got = {r.doc_id: r for r in periods.periodic_runs(spark.createDataFrame(rows, DOC)).collect()}
    assert (got[1].n_runs, got[1].length, got[1].period) == (1, 60_000, 1)
    assert (got[2].n_runs, got[2].start, got[2].length, got[2].period) == (2, 0, 63_000, 7)


def test_collapsed_texts(spark):
    rows = spark.createDataFrame([(1, "say " + "ha " * 20 + "end"), (2, "nothing  here"), (3, None)], DOC)
    got = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in periods.collapsed(rows).collect()}
    assert got == {1: ("say ha end", [(1, 20, 1)]), 2: ("nothing here", []), 3: ("", [])}


def test_runs_of_the_table(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet", columns=["doc_id", "text"])
    some = docs[docs["text"].fillna("").str.len() < 6_000]
    expected = sorted((brute_report(int(i), t) for i, t in zip(some["doc_id"], some["text"], strict=True)), key=str)
    got = {r[0]: tuple(r) for r in periods.query(spark, DIR).collect()}
    assert len(got) == len(docs)
    assert sorted((got[e[0]] for e in expected), key=str) == expected


def test_near_copies_below_the_threshold_give_no_square_of_pairs(spark, monkeypatch):
    """Sets that pass the filters without being linked, but for a few: pairs stay in proportion to the sets, and no link is lost."""
    rng, rows = np.random.default_rng(3), []
    base = [f"b{k}" for k in range(1000)]
    for i in range(100):
        words = list(base)
        for k, at in enumerate(rng.choice(120, 5, replace=False) * 8):
            words[at : at + 7] = [f"x{i}_{k}_{m}" for m in range(7)]
        rows.append((i, " ".join(words)))
        if i % 20 == 0:
            words[500:510] = [f"y{i}_{m}" for m in range(10)]
            rows.append((1000 + i, " ".join(words)))
    sets = {i: {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    link = {a: {b for b in sets if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])} for a in sets}
    counts, real = [], ngram_join.candidates

    def counted(*args):
        got = real(*args)
        counts.append((got[0] if isinstance(got, tuple) else got).count())
        return got

    monkeypatch.setattr(ngram_join, "candidates", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {a: a for a in sets}
    while (new := {a: min(want[b] for b in link[a]) for a in sets}) != want:
        want = new
    assert got == want and len(set(got.values())) == 100
    assert max(counts) <= ngram_join.DENSE * len(rows), counts
