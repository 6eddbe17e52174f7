"""Operators of the llm subpackage: brute force, planted cases and odd inputs."""

import hashlib
import pickle
import random
import re
import subprocess
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import common, components, decontaminate, language, licenses, lines, mixing, neighbours, paragraphs, pitman_yor, registry, secrets, similarity, simhash

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(400)]


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, long and astral texts, and extra columns whose names clash."""
    long = sentence(1, 30_000)
    rows = [(1, "Hello World, hello world"), (2, None), (3, ""), (None, "no id here at all"), (4, "   \n \n"), (5, long), (6, "same text"), (6, "same text"), (7, "\U0001f600 password = abcdef123 \U0001f600"), (8, "123 456")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, pos int")
    return df.select("*", F.lit("other").alias("TEXT"), F.lit(9).alias("doc"))


@pytest.fixture(scope="module")
def docs_of(odd):
    return common.pick(odd, "doc_id", "text")


def empty(spark, schema: str = DOC):
    return spark.createDataFrame([], schema)


def with_tables(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_duckdb(spark, name):
    ours = registry.queries()[name](spark, DIR).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    theirs = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = lambda df: sorted(tuple("" if pd.isna(v) else str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    for c in ours.columns:
        if str(ours[c].dtype).startswith(("float", "int")):
            ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype("float64")
    assert key(ours) == key(theirs)


# 1


def brute_hits(text: str | None, items: list[tuple[object, str]], window: int = 10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def test_decontamination_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    items = [(i, sentence(i, n)) for i, n in enumerate((4, 10, 11, 25, 60, 12))] + [(100, "the the the the the the the the the the the the"), (101, None), (102, "")]
    texts = [sentence(1000 + i, 80) for i in range(30)]
    for i in range(12):
        t = items[i % 6][1].split()
        cut = r.randrange(len(t))
        texts[i] = sentence(i, 20) + " " + " ".join(t[: max(3, cut)]) + " " + sentence(i + 50, 10) + " " + " ".join(t).upper()
    texts += ["the " * 40, None, "", items[3][1], items[3][1] + " " + items[3][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = with_tables(spark, tmp_path, documents=docs, benchmark=bench)
    got = {x["doc_id"]: x for x in decontaminate.query(spark, d).collect()}
    for i, t in enumerate(texts):
        n, hit, ids = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (n, hit, len(ids)), i
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest() and got[i]["contaminated"] == (hit > 0)


def test_proximity_matches(spark):
    item = sentence(3, 12)
    near = item.split()
    near[6] = "other"
    docs = spark.createDataFrame([(1, sentence(8, 20) + " " + " ".join(near)), (2, sentence(9, 30))], DOC)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.proximity(docs, bench).collect()
    assert [(r["doc"]["id"], r["item_id"], r["shift"], r["best"]) for r in found] == [(1, 1, 20, 9)]
    assert decontaminate.matches(docs, bench).count() == 0


def test_stage_rejects_near_passages(spark, tmp_path):
    item = sentence(31, 50)
    near = ["changed" if k % 10 == 9 else w for k, w in enumerate(item.split())]
    d = with_tables(spark, tmp_path, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs = spark.createDataFrame([(1, sentence(8, 20) + " " + " ".join(near)), (2, sentence(9, 30)), (3, item)], DOC)
    assert [r["doc_id"] for r in decontaminate.stage(spark, docs, d).collect()] == [2]


# 2


def test_repeated_passage_is_found_anywhere(spark):
    passage = sentence(77, 60)
    docs = spark.createDataFrame([(i, sentence(200 + i, 90) + (" " + passage if i in (3, 8) else "") + " " + sentence(300 + i, 70)) for i in range(12)], DOC)
    got = {r["doc_id"]: r for r in paragraphs.substring_duplicates(docs).collect()}
    assert {i for i, r in got.items() if r["n_removed"]} == {8} and {i for i, r in got.items() if r["n_shared"]} == {3, 8}
    assert got[8]["n_removed"] >= 32 and all(90 <= s["start"] and s["stop"] <= 150 for s in got[8]["removed"])


def test_repeats_equal_brute_force(spark):
    """Against all pairs of texts: runs of 60 shared words are found, documents without a shared run of 32 words are left alone."""
    r = random.Random(31)
    passages = [sentence(900 + k, n) for k, n in enumerate((60, 75, 31, 24))]
    texts = []
    for i in range(40):
        parts = [sentence(5000 + 10 * i + k, r.randrange(10, 50)) for k in range(3)]
        if i % 3 == 0:
            parts.insert(r.randrange(4), passages[r.randrange(4)])
        texts.append((" " if i % 2 else "\n").join(parts))
    words = [t.split() for t in texts]
    grams = [{tuple(w[i : i + 32]) for i in range(len(w) - 31)} for w in words]
    long = [{tuple(w[i : i + 60]) for i in range(len(w) - 59)} for w in words]
    got = {x["doc_id"]: x for x in paragraphs.substring_duplicates(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    for i in range(40):
        some, much = (any(j != i and z[i] & z[j] for j in range(40)) for z in (grams, long))
        assert not got[i]["n_shared"] or some, i
        assert got[i]["n_shared"] >= 32 or not much, i


def test_near_lines_equal_brute_force(spark):
    """All pairs of long lines at a Jaccard similarity of 0.9 or more come into one cluster, none below 0.8 by itself."""
    r, rows = random.Random(12), []
    for k in range(30):
        w = sentence(7000 + k, 60).split()
        other = list(w)
        for at in r.sample(range(60), r.choice((1, 1, 6))):
            other[at] = "new"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    got = {x["doc_id"]: x["cluster"] for x in paragraphs.substring_duplicates(spark.createDataFrame(rows, DOC)).collect() if x["n_shared"] >= 60}
    for k in range(0, 60, 2):
        a, b = shingles_of(rows[k][1]), shingles_of(rows[k + 1][1])
        near = len(a & b) / len(a | b)
        assert (near < 0.9 or got[k] == got[k + 1]) and (near >= 0.8 or k not in got), (k, near)


def test_near_lines_are_found_by_bands(spark):
    line = sentence(5, 80).split()
    other = [*line[:40], "changed", *line[41:]]
    docs = spark.createDataFrame([(1, sentence(1, 30) + "\n" + " ".join(line)), (2, sentence(2, 30) + "\n" + " ".join(other)), (3, sentence(3, 60))], DOC)
    got = {r["doc_id"]: r["n_removed"] for r in paragraphs.substring_duplicates(docs).collect()}
    assert got == {1: 0, 2: 80, 3: 0}


# 3


def test_held_out_accuracy(spark):
    r = language.query(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    held = r.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.97 and held[1] >= 0 and held[2] <= 1


def test_language_of_odd_texts(spark, docs_of):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("en", "the dog and the cat"), ("de", "der hund und die katze"), ("de", "die katze und der hund")], "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    got = {r["doc_id"]: r for r in language.identify(docs_of, language.fit(train)).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[8]["lang_pred"] == "und" and got[1]["lang_pred"] in ("de", "en")
    none = language.fit(empty(spark, "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(docs_of, none).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    assert language.words_of("\u00bd \u00b2 12 \u2460 3") == {} and language.words_of("x\u00b2 m\u00b3 X") == {"x": 2, "m": 1}
    train = spark.createDataFrame([(i, "de", "der hund und die katze", ) for i in range(3)], "doc_id long, lang string, text string")
    docs = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "12 \u2460 3"), (3, "hund")], DOC)
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(train)).collect()} == {1: "und", 2: "und", 3: "de"}


def test_training_sample_keeps_its_bound(spark):
    docs = spark.createDataFrame([(None, "en", "same text")] * 30 + [(i, "en", f"text {i}") for i in range(30)] + [(i, "de", f"text {i}") for i in range(3)], "doc_id long, lang string, text string")
    n = {r["lang"]: r["count"] for r in language.training_sample(docs, 10).groupBy("lang").count().collect()}
    assert 0 < n.get("en", 1) <= 10 and n["de"] == 3


def brute_language(rows: list[tuple], per_language: int) -> dict:
    """Word-first backing off with plain loops, over the same training rows."""
    import math

    counts: dict = {}
    for _, lang, text in rows:
        for w in re.findall(r"[a-z]+", text.lower()):
            for kind, keys in [(0, [w])] + [(n, [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)) for n in range(1, 6)]:
                for k in keys:
                    counts.setdefault(kind, {}).setdefault(k, {}).setdefault(lang, 0)
                    counts[kind][k][lang] += 1
    langs = sorted({r[1] for r in rows})
    known = {kind: {k: c for k, c in ((k, {x: n for x, n in c.items() if n >= 2}) for k, c in table.items()) if c} for kind, table in counts.items()}
    total = {kind: {x: sum(c.get(x, 0) for c in table.values()) for x in langs} for kind, table in known.items()}

    def log(kind, key):
        return [math.log(known[kind][key].get(x, 0) + 0.5) - math.log(total[kind][x] + 0.5 * (len(known[kind]) + 1)) for x in langs]

    def score(w):
        if w in known[0]:
            return log(0, w)
        for n in range(5, 0, -1):
            own = [log(n, g) for g in ([f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)) if g in known[n]]
            if own:
                return [sum(c) / len(own) for c in zip(*own, strict=True)]
        return [0.0] * len(langs)

    out = {}
    for i, _, text in rows:
        words = re.findall(r"[a-z]+", text.lower())
        mean = [sum(c) / len(words) for c in zip(*map(score, words), strict=True)]
        odds = [math.exp(2 * (m - max(mean))) for m in mean]
        out[i] = (langs[odds.index(max(odds))], max(odds) / sum(odds))
    return out


def test_language_equals_brute_force(spark):
    r = random.Random(9)
    stems = {"aa": ["kala", "talo", "vesi", "puu"], "bb": ["haus", "wasser", "baum", "kala"]}
    rows = [(i, lang, " ".join(r.choice(stems[lang]) + r.choice(["", "n", "st", "ssa"]) for _ in range(5))) for i in range(40) for lang in [r.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identify(docs, language.fit(docs)).collect()}
    want = brute_language(rows, 100)
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-4) for i in want)


def test_language_workers_hold_arrays_and_few_counts(monkeypatch):
    """What a worker loads of the model is a few bytes a key, and what it counts is sent on before it grows."""
    r = random.Random(2)
    keys = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(200_000)]
    counts = pd.DataFrame({"lang": ["aa", "bb"] * 100_000, "kind": [k % 6 for k in range(200_000)], "key": language.hashed(keys).view(np.int64), "n": 2})
    blob = pickle.dumps(language.model_tables(counts))
    tracemalloc.start()
    predict = language.predictor(*pickle.loads(blob))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 6e6 and predict(" ".join(keys[:50]))[0] in ("aa", "bb")
    texts = pd.DataFrame({"lang": ["aa", "bb"] * 20, "text": [" ".join(keys[30 * i : 30 * i + 30]) for i in range(40)]})
    whole = list(language.counted(iter([texts])))
    monkeypatch.setattr(language, "ENTRIES", 1_000)
    cut = list(language.counted(iter([texts])))
    total = lambda parts: pd.concat(parts).groupby(["lang", "kind", "key"])["n"].sum().to_dict()
    assert len(whole) == 1 and len(cut) > 3 and max(map(len, cut)) < 2_000 and total(cut) == total(whole)


# 4


def test_ledger_scans_only_what_is_new(spark, docs_of):
    first = common.stored(secrets.scan_new(docs_of, rules=secrets.RULES[:1]), "t")
    assert first.count() == docs_of.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert secrets.scan_new(docs_of, first, secrets.RULES[:1]).count() == 0
    more = secrets.scan_new(docs_of, first, secrets.RULES[:2])
    assert {tuple(r["rules"]) for r in more.collect()} == {("access@1",)}
    grown = docs_of.union(spark.createDataFrame([(70, "token: zzzzzz9 AKIA" + "A" * 16)], DOC))
    new = common.stored(secrets.scan_new(grown, first.unionByName(more), secrets.RULES[:2]), "t")
    assert new.count() == 1 and [f["kind"] for f in new.first()["findings"]] == ["assign", "access"]
    paths = secrets.findings_by_path(grown, first.unionByName(new), secrets.RULES[:2])
    spans = {r["doc_id"]: [(f["start"], f["stop"]) for f in r["findings"]] for r in paths.collect()}
    assert spans[7] == [(2, 22)] and spans[70][0] == (0, 14)


def test_runs_share_a_ledger_and_new_rule_versions_replace_old(spark, tmp_path):
    path, text = str(tmp_path / "ledger"), "AKIA" + "A" * 16
    docs = spark.createDataFrame([(1, text), (2, text), (3, "nothing"), (4, None)], DOC)
    rows = lambda: spark.read.parquet(path).select("blob", F.explode("rules").alias("rule")).collect()
    spans = lambda df: {r["doc_id"]: [(f["kind"], f["start"], f["stop"]) for f in r["findings"]] for r in df.collect()}
    old = secrets.RULES[:2]
    assert spans(secrets.scan_into(docs, path, old)) == {1: [("access", 0, 20)], 2: [("access", 0, 20)], 3: [], 4: []}
    assert len(rows()) == 3 * 2
    grown = docs.union(spark.createDataFrame([(5, "x " + text)], DOC))
    assert spans(secrets.scan_into(grown, path, old))[5] == [("access", 2, 22)]
    assert len(rows()) == 4 * 2
    stricter = (old[0], ("access", 2, *old[1][2:4], 21, old[1][5]))
    assert spans(secrets.scan_into(grown, path, stricter)) == {i: [] for i in range(1, 6)}
    assert len(rows()) == 4 * 3
    same = (old[0], ("access", 3, *old[1][2:]))
    assert spans(secrets.scan_into(grown, path, same))[1] == [("access", 0, 20)]
    assert spans(secrets.scan_into(grown, path, old))[1] == [("access", 0, 20)] and len(rows()) == 4 * 4


def test_failed_match_consumes_its_text(spark, tmp_path):
    d = with_tables(spark, tmp_path, documents=spark.createDataFrame([(1, "secret: token: abcdefg"), (2, "token=token=abcdefgh"), (3, "x" + "a" * 24 + " AKIA" + "B" * 15)], DOC))
    got = {r["doc_id"]: r for r in secrets.query(spark, d).collect()}
    assert got[1]["n_assign"] == 0 and got[2]["spans"] == "assign:0:20" and got[3]["spans"] == "hex:1:25" and got[3]["n_access"] == 0


# 5


def test_recall_and_ties(spark):
    emb = common.table(spark, DIR, "embeddings").select("vec_id", "embedding")
    x = emb.toPandas()
    m = np.array([np.array(v, float) for v in x["embedding"]])
    got = neighbours.nearest(emb, F.col("vec_id") % 20 == 0).toPandas()
    hit = total = 0
    for q in x["vec_id"][x["vec_id"] % 20 == 0]:
        s = m @ m[x.index[x["vec_id"] == q][0]]
        best = [x["vec_id"][j] for j in np.lexsort((x["vec_id"], -s)) if x["vec_id"][j] != q][:20]
        hit += len(set(best) & set(got[got["query_id"] == q]["vec_id"]))
        total += 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_through_the_curves(spark, clusters, monkeypatch):
    """5,000 vectors in 24 dimensions, without structure or in clusters, in blocks of 128: recall in all and by query."""
    r = np.random.default_rng(7)
    x = r.normal(size=(5000, 24))
    if clusters:
        x = r.normal(size=(clusters, 24))[r.integers(0, clusters, 5000)] + 0.25 * x
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 128)
    monkeypatch.setattr(neighbours, "MOST_QUERIES", 50)
    got = neighbours.nearest(emb, F.col("vec_id") % 20 == 0).toPandas()
    found = []
    for q in range(0, 5000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        found.append(len(set(np.lexsort((np.arange(5000), -s))[:20].tolist()) & set(got[got["query_id"] == q]["vec_id"])) / 20)
    assert np.mean(found) >= 0.9 and np.mean(np.array(found) >= 0.8) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [0.5, 0.5]), (None, [1.0, 1.0])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(emb, F.col("vec_id") % 20 == 0).toPandas()
    assert set(got["query_id"]) == {0, 20, 40} and list(got[got["query_id"] == 20].sort_values("rank")["vec_id"]) == list(range(20))
    assert neighbours.nearest(empty(spark, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


# 6


def test_model_counts_and_beats_the_base(spark):
    r = pitman_yor.query(spark, "/root/testdata/sf0.01").toPandas()
    held = r[r["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and (r["perplexity"] > 1).all()
    x = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").toPandas()
    n = sum(len(t.encode().split()) + 1 for i, t in zip(x["doc_id"], x["text"], strict=True) if zlib.crc32(str(i).encode()) % 10)
    assert set(r["train_tokens"]) == {n}


def test_spelling_is_a_distribution(spark):
    """Over all words of one letter of a tiny alphabet and longer ones the probabilities stay below one in sum."""
    words = spark.createDataFrame([(bytes([97 + i % 3] * (1 + i % 4)), i, 5 + i, 2 + i % 3) for i in range(12)], "word binary, w long, n long, m long")
    p = pitman_yor.word_probabilities(words)
    assert 0.5 < p.agg(F.sum("p")).first()[0] <= 1.0


def test_seating_bounds_and_repeats():
    key = np.arange(1000, dtype=np.uint64)
    c = np.arange(1000)
    a = pitman_yor.seated(key, c, np.full(1000, 50), np.full(1000, 0.01), 0.7, 10.0, 1)
    assert (a <= c).all() and (a[1:] >= 1).all() and a[0] == 0 and np.array_equal(a, pitman_yor.seated(key, c, np.full(1000, 50), np.full(1000, 0.01), 0.7, 10.0, 1))


def test_seating_follows_the_restaurant():
    """The mean number of tables over many dishes against customers drawn one by one."""
    r, n, c = np.random.default_rng(3), 4000, 300
    want = np.ones(n)
    for k in range(1, c):
        new = (5.0 + 0.8 * (20 + want)) * 0.02
        want += r.random(n) < new / (new + k - 0.8 * want)
    got = pitman_yor.seated(np.arange(n, dtype=np.uint64), np.full(n, c), np.full(n, 20), np.full(n, 0.02), 0.8, 5.0, 0)
    assert abs(got.mean() - want.mean()) < 5 * want.std() / n**0.5 + 0.01 * want.mean() and 0.8 < got.std() / want.std() < 1.2


def test_pairs_equal_brute_force(spark):
    texts = [(i, sentence(i % 5, 30) + " " + sentence(700 + i, 10), i % 4 == 0) for i in range(40)] + [(50, None, False), (51, "w1 " * 600, False), (52, "", True)]
    docs = pitman_yor.with_piece(common.stored(spark.createDataFrame(texts, "doc_id long, text string, held_out boolean"), "t"), "text", "held_out")
    train, asked = Counter(), Counter()
    for _, t, held in texts:
        w = ["", *(t or "").split(), ""]
        for pair in zip(w, w[1:], strict=False):
            train[pair] += not held
            asked[pair] += 1
    want = sorted(train[p] for p in train if train[p] > 1 or train[p] == 1 and asked[p] > 1)
    assert sorted(r["c"] for r in pitman_yor.pair_table(docs, 3).collect()) == want
    words = {bytes(r["word"]).decode(): r["n"] for r in pitman_yor.word_table(docs, 3).collect()}
    assert words == {w: sum(c for (_, x), c in train.items() if x == w) for w in {w for p in train for w in p}}


def test_base_score_equals_brute_force(spark):
    texts = [(i, t, i % 3 == 0) for i, t in enumerate(["A b b", "b c", None, "c  c\nD", "", "zz b", "a A a"])]
    got = {r["doc_id"]: r for r in pitman_yor.score_documents(spark.createDataFrame(texts, "doc_id long, text string, held_out boolean")).collect()}
    tokens = {i: [*(t or "").lower().split(), None] for i, t, _ in texts}
    counts = Counter(w for i, _, held in texts if not held for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        want = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert got[i]["base_score"] == pytest.approx(want) and got[i]["n_tokens"] == len(own) and got[i]["n_known"] == sum(counts[w] > 0 for w in own) and got[i]["train_tokens"] == n


def test_scores_of_odd_texts(spark, docs_of):
    r = pitman_yor.score_documents(docs_of.withColumn("held_out", F.coalesce(F.col("doc_id") == 1, F.lit(False)))).toPandas()
    assert len(r) == 10 and r[r["doc_id"] == 2]["n_tokens"].item() == 1 and np.isfinite(r["score"]).all()


def test_words_before_count(spark):
    """Text in the order of the training texts scores better than the same words shuffled."""
    r = random.Random(4)
    songs = [sentence(500 + i, 12) for i in range(10)]
    train = [(i, " ".join(r.choice(songs) for _ in range(5))) for i in range(60)]
    text = " ".join(songs[:6])
    mixed = text.split()
    r.shuffle(mixed)
    docs = spark.createDataFrame([*train, (1000, text), (1001, " ".join(mixed))], DOC).withColumn("held_out", F.col("doc_id") >= 1000)
    got = {x["doc_id"]: x for x in pitman_yor.score_documents(docs).collect()}
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"]) and got[1000]["score"] > got[1001]["score"] + 30


def test_contexts_are_distributions(spark):
    """In each context the served words and the rest left to the parent sum to one."""
    texts = [(i, sentence(i % 7, 30), False) for i in range(20)]
    docs = pitman_yor.with_piece(common.stored(spark.createDataFrame(texts, "doc_id long, text string, held_out boolean"), "t"), "text", "held_out")
    words, pairs = common.stored(pitman_yor.word_table(docs, 2), "w"), common.stored(pitman_yor.pair_table(docs, 2), "p")
    assert pairs.agg(F.min("c")).first()[0] > 1
    every, held = pitman_yor.fitted(words, pairs, sweeps=1)
    w = pitman_yor.by_id(every)
    one = held.join(w.select(F.col("id").alias("w"), F.col("p").alias("p0")), "w").groupBy("u").agg(F.sum("p").alias("p"), F.sum("p0").alias("p0")).join(w.select(F.col("id").alias("u"), "back"), "u")
    low, high = one.agg(F.min(F.col("p") + F.col("back") * (1 - F.col("p0"))), F.max(F.col("p") + F.col("back") * (1 - F.col("p0")))).first()
    assert low == pytest.approx(1.0) and high == pytest.approx(1.0)


def test_blocks_of_pairs_seat_alike_however_cut(spark, monkeypatch):
    """Pairs stay in bounded blocks; what words and blocks tell each other adds up to the same seating. An answer for a pair takes twelve bytes."""
    texts = [(i, sentence(i % 7, 30), False) for i in range(20)]
    docs = pitman_yor.with_piece(common.stored(spark.createDataFrame(texts, "doc_id long, text string, held_out boolean"), "t"), "text", "held_out")
    words, pairs = common.stored(pitman_yor.word_table(docs, 2), "w"), common.stored(pitman_yor.pair_table(docs, 2), "p")
    rows = lambda: sorted(map(tuple, pitman_yor.fitted(words, pairs)[1].collect()))
    whole = rows()
    monkeypatch.setattr(pitman_yor, "BLOCK", 1)
    sums = [(np.arange(k, dtype=np.uint64), np.arange(k, dtype=np.uint64), np.full(k, 2), np.ones(k, np.int32), np.zeros(k, np.int32)) for k in (3, 1)]
    assert [len(b["c"][0]) // 8 for b in pitman_yor.in_blocks(iter(sums))] == [3, 1]
    assert rows() == whole and len(whole) == pairs.count() > 100
    assert sum(np.dtype(t).itemsize for _, t in pitman_yor.PAIR_FIELDS) == 12


# 7


def test_mix_of_odd_rows(spark, tmp_path):
    d = with_tables(spark, tmp_path, documents=spark.createDataFrame([(i, f"s{i % 3}" if i % 7 else None, "a b c" if i % 5 else None) for i in range(500)], "doc_id long, source string, text string"))
    r = mixing.query(spark, d).toPandas()
    assert (r["taken"] <= 3 * r["size"]).all() and len(r) == 500
    r["source"] = [f"s{i % 3}" if i % 7 else "" for i in r["doc_id"]]
    fraction = (r["target"] / r["source_size"]) % 1
    r["spread"] = r["size"] ** 2 * fraction * (1 - fraction)
    by = r.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), spread=("spread", "sum"))
    assert by["target"].sum() == pytest.approx(r["size"].sum()) and ((by["taken"] - by["target"]).abs() <= 4.5 * by["spread"] ** 0.5 + 1e-6).all()
    assert mixing.query(spark, with_tables(spark, tmp_path / "none", documents=empty(spark, "doc_id long, source string, text string"))).count() == 0


# 8


def line_sets(text: str | None) -> list[frozenset]:
    return [frozenset(line.split()) for line in text.encode().lower().split(b"\n")] if text else []


def brute_lines(texts: dict[int, str | None], threshold: float = 0.8) -> tuple[dict, dict]:
    """By document: the lines with an earlier line of the same or a similar set, and the number of other sets that their sets reach."""
    rows = [(i, k, s) for i, t in sorted(texts.items()) for k, s in enumerate(line_sets(t)) if s]
    first: dict[frozenset, int] = {}
    for at, (_, _, s) in enumerate(rows):
        first.setdefault(s, at)
    sets = list(first)
    near = {s: [x for x in sets if x != s and len(s & x) >= threshold * len(s | x) - 1e-9] for s in sets}
    goes = [first[s] < at or any(first[x] < first[s] for x in near[s]) for at, (_, _, s) in enumerate(rows)]
    removed = {i: sorted(k for (d, k, _), g in zip(rows, goes, strict=True) if d == i and g) for i in texts}
    return removed, {i: sum(len(near[s]) for s in set(line_sets(t)) if s) for i, t in texts.items()}


def check_lines(spark, texts: dict[int, str | None]):
    got = lines.with_removed(spark.createDataFrame(list(texts.items()), DOC)).collect()
    removed, links = brute_lines(texts)
    assert {x["doc_id"]: x["removed"] for x in got} == removed and {x["doc_id"]: x["links"] for x in got} == links


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(3)
    base = [sentence(i, 12 + i % 9) for i in range(8)]

    def variant(t):
        w = t.split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        return " ".join(w)

    texts = {i: "\n".join([variant(r.choice(base)) for _ in range(4)] + [sentence(900 + i, 10), ""]) for i in range(25)} | {100: None, 101: "", 102: "one\none\nOne  one"}
    check_lines(spark, texts)


def test_a_crowd_of_near_copies_keeps_all_links(spark):
    """Near copies of one line, all different, are verified in chunks; chains and unlike lines of the same rare word too."""
    r = random.Random(17)
    base = sentence(8, 40).split()
    near = [" ".join(f"n{k}" if at == r.randrange(40) else w for at, w in enumerate(base)) for k in range(90)]
    chain = [" ".join(f"c{j}" for j in range(k, k + 20)) for k in range(0, 80, 2)]
    apart = [" ".join(["zzzrare", *sentence(4000 + k, 18).split()]) for k in range(80)]
    every = near + chain + apart
    r.shuffle(every)
    texts = {i: "\n".join(every[5 * i : 5 * i + 5]) for i in range(len(every) // 5)}
    check_lines(spark, texts)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(similarity, "CHUNK", 16)
        m.setattr(similarity, "MOST", 20)
        check_lines(spark, texts)


def test_a_frequent_word_of_unlike_lines_makes_no_crowd(spark, monkeypatch):
    """Over 2,048 unlike lines under one word are compared where they meet, each with partners of fitting length and place only, not dealt out as pairs of chunks."""
    r = np.random.default_rng(5)
    sets = np.zeros((8000, 30), np.float32)
    for row in sets:
        row[r.choice(30, 10, replace=False)] = 1
    sets = np.unique(sets, axis=0)
    crowded, counts = [], similarity.crowd_counts
    monkeypatch.setattr(lines, "crowd_counts", lambda crowds, *rest: (crowded.append(crowds.count()), counts(crowds, *rest))[1])
    texts = ["\n".join(" ".join(f"w{k}" for k in np.flatnonzero(x)) for x in sets[at : at + 100]) for at in range(0, len(sets), 100)]
    got = {x["doc_id"]: (x["removed"], x["links"]) for x in lines.with_removed(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    linked = sets @ sets.T >= 9
    np.fill_diagonal(linked, False)
    assert linked.any() and crowded == [0]
    for i in got:
        own = np.arange(100 * i, min(100 * i + 100, len(sets)))
        assert got[i] == ([k for k, x in enumerate(own) if linked[x, :x].any()], int(linked[own].sum()))


def test_the_line_stage_makes_no_crowd_of_a_frequent_word(spark, monkeypatch):
    """In the pipeline too: unlike lines under one word, more than 2,048, are compared where they meet; later similar lines leave the texts."""
    r = np.random.default_rng(6)
    sets = np.zeros((7000, 30), np.float32)
    for row in sets:
        row[r.choice(30, 10, replace=False)] = 1
    sets = np.unique(sets, axis=0)
    crowded, counts = [], similarity.crowd_counts
    monkeypatch.setattr(lines, "crowd_counts", lambda crowds, *rest: (crowded.append(crowds.count()), counts(crowds, *rest))[1])
    each = [" ".join(f"w{k}" for k in np.flatnonzero(x)) for x in sets]
    texts = [each[at : at + 100] for at in range(0, len(each), 100)]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], DOC)
    got = {x["doc_id"]: x["text"].split("\n") for x in lines.stage(spark, docs, "").collect()}
    linked = np.tril(sets @ sets.T >= 9, -1).any(axis=1)
    assert linked.any() and crowded == [0]
    assert got == {i: [x for k, x in enumerate(t) if not linked[100 * i + k]] for i, t in enumerate(texts)}


def test_blocks_of_prefixes_keep_their_bound_and_all_links(spark, monkeypatch):
    """Words whose rows come in many pieces and are too many to be held are dealt out; the links stay the same."""
    r = random.Random(23)
    near = [" ".join(f"n{k}" if at == k % 12 else f"w{at}" for at in range(12)) for k in range(60)]
    apart = [" ".join(["rareandlong", *sentence(7000 + k, 14).split()]) for k in range(60)]
    every = near + apart
    r.shuffle(every)
    for name, value in (("MOST", 15), ("CHUNK", 16), ("SENT_ROWS", 30), ("HELD_ROWS", 40)):
        monkeypatch.setattr(similarity, name, value)
    check_lines(spark, {i: "\n".join(every[4 * i : 4 * i + 4]) for i in range(len(every) // 4)})


def test_lines_of_the_query(spark, tmp_path):
    rows = [(1, "a b c\nx y z w v\n"), (2, "v w z y x\nnew one here"), (3, None), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, "")]
    d = with_tables(spark, tmp_path, documents=spark.createDataFrame(rows, DOC))
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["removed_lines"], r["n_links"]) for r in lines.query(spark, d).collect()), key=str)
    assert got == sorted([(1, 3, 0, "", 0), (2, 2, 1, "0", 0), (3, 0, 0, "", 0), (None, 1, 1, "0", 0), (4, 1, 1, "0", 0), (4, 1, 1, "0", 0), (5, 1, 0, "", 0)], key=str)


def test_failed_candidates_hide_no_link(spark):
    """In a large group unverified candidates may not shadow a link: many sets just below the threshold share a rare token."""
    r = random.Random(11)
    core = [f"c{i}" for i in range(16)]
    texts = {i: " ".join(["rareandlongtoken", *core[: 13 + i % 3], *[f"u{r.randrange(12)}" for _ in range(4)]]) for i in range(60)}
    check_lines(spark, texts)


# 9


def test_fingerprint_equals_the_definition():
    for t in ("a b", "", None, "A b C d e f", sentence(4, 300), "é ñ x y z w"):
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))
        assert simhash.fingerprint(t) == want


def test_links_equal_brute_force(spark):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    fps |= {0, 1, 3, (1 << 64) - 1}
    x = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(simhash.signed(int(v)),) for v in x], "fp long")
    for chunk in (2048, 8):
        parts = {r["node"]: r["component"] for r in components.connected_components(simhash.fingerprint_links(df, chunk=chunk)).collect()}
        ours = [parts.get(simhash.signed(int(v)), simhash.signed(int(v))) for v in x]
        assert len(set(ours)) == len(set(label)) and len(set(zip(ours, label.tolist(), strict=True))) == len(set(label))


def test_near_duplicates_of_odd_rows(spark, docs_of):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of).collect()}
    assert got[2] == got[3] == got[4] == 2 and got[6] == 6 and got[5] == 5
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_stage_keeps_one_of_a_group_and_all_without_words(spark):
    text = sentence(6, 200)
    near = " ".join(["changed" if k == 100 else w for k, w in enumerate(text.split())])
    rows = [(1, text), (2, near), (3, text), (3, text), (4, sentence(7, 200)), (5, "\n\t"), (6, " "), (7, None), (8, "\n")]
    kept = simhash.stage(spark, spark.createDataFrame(rows, DOC), DIR)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7, 8]


def shingles_of(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_links_exactly_the_pairs_of_similar_shingle_sets(spark):
    """Pairs of texts on both sides of 0.8 against brute force; fingerprints within 7 bits missed most of those near it."""
    r, rows = random.Random(21), []
    for k in range(40):
        base = sentence(2000 + k, 150 + 5 * k).split()
        other = list(base)
        for at in r.sample(range(len(base)), max(1, round(len(base) * (0.014 + 0.0006 * k)))):
            other[at] = f"new{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    rows += [(200 + k, sentence(1, n)) for k, n in enumerate((1, 2, 3, 4, 5, 6))]
    kept = {x["doc_id"] for x in simhash.stage(spark, spark.createDataFrame(rows, DOC), DIR).collect()}
    sets, near = {i: shingles_of(t) for i, t in rows}, set()
    for i in range(0, 80, 2):
        a, b = sets[i], sets[i + 1]
        near |= {i + 1} if len(a & b) >= 0.8 * len(a | b) - 1e-9 else set()
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows}
    far = sum((prints[i] ^ prints[i - 1]).bit_count() > 7 for i in near)
    assert 5 < len(near) < 38 and far > 3
    assert set(dict(rows)) - kept == near


def test_stage_links_by_simhash_first(spark):
    """The stage's fingerprints follow the definition, and what they link is near in bits and similar as a set."""
    rows = [(i, sentence(300 + i, 120)) for i in range(20)]
    rows += [(100 + i, t + " tail") for i, t in rows] + [(200, "a b"), (201, ""), (202, "é ñ")]
    shingled = common.stored(simhash.shingle_table(spark.createDataFrame(rows, DOC).select("doc_id", "text"), 5, 0.8), "shingled")
    prints = {r["class"]: r["fp"] for r in shingled.where("class <> 0").collect()}
    found = [(r["a"], r["b"]) for r in simhash.near_by_fingerprint(shingled, 0.8).collect()]
    assert len(found) >= 15 and all((prints[a] ^ prints[b]).bit_count() <= 4 if (prints[a] ^ prints[b]) >= 0 else (2**64 + (prints[a] ^ prints[b])).bit_count() <= 4 for a, b in found)
    h = np.random.default_rng(3).integers(0, 2**63, 40, np.int64).view(np.uint64) * np.uint64(2)
    text = np.sort(np.random.default_rng(4).integers(0, 6, 40))
    want = [simhash.signed(sum(1 << b for b in range(64) if len(h[text == t]) and 2 * sum(int(x) >> b & 1 for x in h[text == t]) > len(h[text == t]))) for t in range(8)]
    assert simhash.fingerprints_of(h, text, 8).tolist() == want


def test_link_matrix_in_slices_equals_plain_sets(monkeypatch):
    r = np.random.default_rng(12)
    base = r.integers(0, 1 << 40, 400).astype(np.uint64)
    sets = [np.sort(np.unique(np.r_[base[r.random(400) < 0.97], r.integers(0, 1 << 40, 5).astype(np.uint64)])) for _ in range(30)]
    monkeypatch.setattr(similarity, "BLOCK", 700)
    data, token = [similarity.packed(x) for x in sets], int(base[7])
    plain = [set(x.tolist()) for x in sets]
    for counted in (False, True):
        got = similarity.link_matrix(data[:14], data[14:], token, 0.9, counted)
        for i in range(14):
            for j in range(14, 30):
                both = plain[i] & plain[j]
                first = not counted or not any(x < token for x in both if token in plain[i] or token in plain[j])
                if counted and token not in both:
                    continue
                assert got[i, j - 14] == (len(both) >= 0.9 * len(plain[i] | plain[j]) - 1e-9 and first)


def test_spanning_links_of_sets_connect_what_all_pairs_connect():
    """Parts against the matrix of all pairs; large sets that share half their tokens take no product of matrices."""
    r, sets = np.random.default_rng(13), []
    for k, size in enumerate((12, 60, 300, 300)):
        base = r.integers(0, 1 << 40, size).astype(np.uint64)
        sets += [np.unique(np.r_[base[r.random(size) < (0.95, 0.93, 0.92, 0.6)[k]], r.integers(0, 1 << 40, 2).astype(np.uint64)]) for _ in range(40)]
    data = [similarity.packed(sets[k]) for k in r.permutation(len(sets))]

    def parts(links):
        root = list(range(len(data)))
        for a, b in links:
            old, new = root[b], root[a]
            root = [new if x == old else x for x in root]
        return {frozenset(k for k, x in enumerate(root) if x == y) for y in root}

    linked = similarity.link_matrix(data, data, 0, 0.8, False)
    got = similarity.spanning(data, 0.8)
    assert all(linked[a, b] for a, b in got) and parts(got) == parts(np.argwhere(linked).tolist())
    assert len(got) == len(data) - len(parts(got)) and 41 < len(parts(got)) < 150
    began = time.time()
    base = r.integers(0, 1 << 40, 2000).astype(np.uint64)
    many = [similarity.packed(np.r_[base[r.random(2000) < 0.5], r.integers(0, 1 << 40, 1000).astype(np.uint64)]) for _ in range(700)]
    assert similarity.spanning(many, 0.8) == [] and similarity.spanning([], 0.8) == [] and time.time() - began < 15


def joins_of(df) -> list:
    """Columns that each join of the optimised plan gives."""
    found, nodes = [], [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            found.append({node.output().apply(k).name() for k in range(node.output().size())})
    return found


def test_repeats_never_move_to_their_cluster(spark):
    """First places go to the documents; null ids and repeated rows are first places too."""
    passage, other = sentence(31, 60), sentence(32, 60)
    docs = spark.createDataFrame([(4, passage), (2, passage), (2, passage), (None, passage), (5, other + "\n" + passage), (None, other)], DOC)
    assert joins_of(paragraphs.repeated(docs)) == []
    got = sorted((str(r["doc_id"]), r["n_shared"], r["n_removed"]) for r in paragraphs.substring_duplicates(docs).collect())
    assert got == [("2", 60, 0), ("2", 60, 0), ("4", 60, 60), ("5", 120, 60), ("None", 60, 60), ("None", 60, 60)]


def test_lines_are_counted_before_the_join(spark, tmp_path, monkeypatch):
    """No text moves with a join that is too large to be sent."""
    rows = [(i, sentence(70 + i % 3, 12) + "\n" + sentence(80 + i, 12)) for i in range(6)] + [(None, None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(lines, "small", lambda df, *a, **b: df)
    df = lines.query(spark, str(tmp_path))
    assert all("text" not in columns for columns in joins_of(df)) and len(joins_of(df)) == 1
    assert sorted((r["doc_id"], r["n_lines"], r["removed_lines"]) for r in df.collect() if r["doc_id"] is not None) == [(i, 2, "0" if i > 2 else "") for i in range(6)]


def test_broadcast_is_bounded_by_what_rows_hold(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    df = spark.range(3).select("id", F.sequence(F.lit(1), F.lit(20)).alias("held"))
    assert hinted(common.small(df, 10, F.size("held"))) and not hinted(common.small(df, 5, F.size("held"))) and not hinted(common.small(df, 2))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[1000 + i] == 1000 for i in range(80)) and len(got) == 131
    assert components.connected_components(empty(spark, "a long, b long")).count() == 0


# 10


def test_license_phrases_and_templates(spark):
    rows = [(1, "MIT License. mit-license"), (2, "cc by\ncc, by"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation"), (4, None), (5, "emit license"), (6, "x Apache  LICENSE")]
    got = {r["doc_id"]: r for r in licenses.licenses(spark.createDataFrame(rows, DOC)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base"]) == (2, 0, 2, ["mit"])
    assert got[2]["n_base"] == 2 and got[3]["labels"] == ["mit"] and 0.8 <= got[3]["score"] <= 1 and got[4]["n_words"] == 0
    assert got[5]["labels"] == [] and got[5]["first_word"] is None and got[5]["score"] == 0.0 and got[6]["first_word"] == 1


def test_deciding_words_of_licenses(spark):
    texts = [
        ("licensed under CC BY 4.0", "cc-by,cc-by-4.0"), ("CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"), ("cc-by-nc-sa 4.0", "cc-by,cc-by-nc-sa-4.0"), ("CC BY-NC 3.0", "cc-by"),
        ("GNU General Public License version 2", "gpl,gpl-2.0"), ("the GNU General Public License, Version 3", "gpl,gpl-3.0"), ("GNU Lesser General Public License version 3", "lgpl-3.0"),
        ("Apache License, Version 1.0", "apache"), ("Apache License, Version 2.0", "apache,apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\nassociated documentation files", "mit"),
        ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\nconditions are met", "bsd"),
        (" ".join(["licensed", sentence(1, 40), "under", sentence(2, 40), "cc", sentence(3, 40), "by", sentence(4, 40), "nc 4 0"]), ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], DOC)
    got = {r["doc_id"]: ",".join(r["labels"]) for r in licenses.licenses(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}


# all of them


def test_every_query_takes_odd_and_empty_tables(spark, odd, tmp_path):
    bench = spark.createDataFrame([(1, "hello world hello"), (None, "x y"), (2, None)], "item_id long, text string")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = common.pick(odd, "doc_id", "text").select("*", F.lit("en").alias("lang"), F.when(F.col("doc_id") > 3, "s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    plain = docs.withColumns({"words": F.lit("x"), "class": F.lit(1), "token": F.lit(2), "_doc": F.lit(3), "fp": F.lit(4), "split": F.lit(5)})
    vectors = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    one = with_tables(spark, tmp_path / "odd", documents=plain, benchmark=bench, embeddings=vectors)
    none = with_tables(spark, tmp_path / "none", documents=empty(spark, schema), benchmark=empty(spark, "item_id long, text string"), embeddings=empty(spark, "vec_id long, embedding array<float>"))
    for name, query in registry.queries().items():
        n = query(spark, one).count()
        assert n == 10 or name in ("pipeline", "op5_nearest_neighbours"), name
        assert query(spark, none).count() == 0, name


def test_stages_keep_columns_and_clean_documents(spark):
    docs = common.pick(common.table(spark, DIR, "documents"), *common.DOCUMENT_COLUMNS)
    bench = {i: t for i, t in common.table(spark, DIR, "benchmark").select("item_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        out = common.stored(out, name)
        if name == "benchmark_decontamination":
            want = {r["doc_id"] for r in docs.collect() if brute_hits(r["text"], list(bench.items()))[1] == 0}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "language_id":
            assert out.count() > 0.9 * docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert last.where("copy > 3").count() == 0


def test_spanning_links_reach_every_pair():
    r = np.random.default_rng(0)
    g = np.sort(r.integers(0, 30, 400))
    v = r.integers(0, 50, 400)
    linked = lambda i, j: np.abs(v[i] - v[j]) <= 2
    for whole in (None, np.ones(400, bool), r.random(30)[g] < 0.5):
        got = common.spanning_links(v, g, linked, whole)
        part = np.arange(400)
        for _ in range(400):
            before = part.copy()
            for i, j in got:
                part[i] = part[j] = min(part[i], part[j])
            if (before == part).all():
                break
        for i in range(400):
            for j in range(i + 1, 400):
                if g[i] == g[j] and abs(v[i] - v[j]) <= 2:
                    assert part[i] == part[j]


def test_overlaps_of_pairs():
    pack = lambda xs: similarity.packed(np.array(xs, np.uint64))
    assert list(similarity.unpacked(pack([5, 3, 1 << 39]))) == [5, 3, 1 << 39]
    a, b = [[4, 9, 1], [7], [3, 2]], [[1, 9], [8], [2, 3, 5]]
    flat = lambda z: np.concatenate([np.array(x, np.uint64) for x in z])
    common, first = similarity.overlaps(flat(a), np.array([3, 1, 2]), flat(b), np.array([2, 1, 3]))
    assert list(common) == [2, 0, 2] and list(first) == [1, 1, 0]


def test_words_of_slabs():
    import pyarrow as pa

    from skyloom.llm import words

    reader, rolling = words.Reader(), words.Rolling()
    texts = ["Hello  wOrld\nab\n\ncd", "", None, "x", "\u00e9\u00c0 ZZ\n", " lead\n\n", "a" * 300_000 + " b c", "b c"]
    known: dict[bytes, int] = {}
    for most in (1, 10, 1 << 20):
        for slab in words.slabs(pa.array(texts), reader, most):
            own = [t or "" for t in texts[slab.rows[0] : slab.rows[1]]]
            want = [(i, w, n) for i, t in enumerate(own) for n, line in enumerate(t.split("\n")) for w in line.encode().split()]
            at, text, number = slab.lines()
            assert [(int(slab.text[k]), bytes(slab.raw[a:b]), int(number[at[k]])) for k, (a, b) in enumerate(zip(slab.starts, slab.stops, strict=True))] == want
            assert [int(text[x]) for x in at] == [i for i, _, _ in want]
            for (_, w, _), h in zip(want, slab.hashes.tolist(), strict=True):
                assert known.setdefault(w.lower(), h) == h
            _, of, start = slab.windows(rolling, 3)
            assert [(int(i), int(s - slab.bounds[i])) for i, s in zip(of, start, strict=True)] == [(i, s) for i, t in enumerate(own) if t.split() for s in range(max(1, len(t.split()) - 2))]
    assert len(set(known.values())) == len(known)


def test_scores_of_very_long_unseen_words_are_finite(spark):
    """A word's spelling may be less likely than any number that is not zero; its logarithm is still told."""
    r = random.Random(5)
    texts = [(i, sentence(i, 40), False) for i in range(30)]
    texts += [(100 + k, f"{sentence(3, 10)} " + "".join(r.choice("qxzjkvw0123456789") for _ in range(k)), True) for k in (1, 10, 60, 200, 1_000, 10_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean")
    got = {x["doc_id"]: x for x in pitman_yor.score_documents(docs).collect()}
    scores = [got[100 + k]["score"] for k in (1, 10, 60, 200, 1_000, 10_000)]
    assert all(np.isfinite(x["score"]) for x in got.values())
    # the longer the unseen word, the less likely, about evenly a byte
    assert all(b < a for a, b in zip(scores, scores[1:], strict=False)) and -4 < (scores[5] - scores[4]) / 9_000 < -0.5


def test_workers_give_back_what_a_task_took():
    """Spark keeps Python workers: in a process of its own, since the allocator's state is the process's."""
    code = """
import re
import numpy as np
from skyloom.llm.common import lean
anon = lambda: int(re.search(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
pins = []
def handle(batches):
    np.ones(3_500_000)
    for n in batches:
        parts = [np.ones(60_000) for _ in range(n)]
        pins.append(np.ones(5_000))
        yield len(parts)
before = anon()
assert list(lean(handle)(iter([400]))) == [400]
print(anon() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(common.__file__).parents[2], check=True)
    assert int(out.stdout) < 60


def test_pairs_of_a_piece_are_summed_in_shares():
    """A million words a piece: what sorting them takes at once is bounded, and the counts are those of all pairs."""
    rng, steps = np.random.default_rng(5), []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, handle, _):
            steps.append(handle)
            return self

        mapInPandas, repartition, sortWithinPartitions = mapInArrow, select, select

    words = np.array([f"w{k}" for k in range(20_000)])
    texts = [" ".join(t) for t in words[rng.integers(0, len(words), (2_000, 500))]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.zeros(len(texts), bool)), pa.array(np.zeros(len(texts), np.int32))], ["text", "held_out", "piece"])
    pitman_yor.pair_table(Docs(), 16)
    peaks, blobs, pairs = [], [], []
    tracemalloc.start()
    for blob in steps[0](iter([batch])):
        blobs.append(blob.to_pandas())
    peaks.append(tracemalloc.get_traced_memory()[1])
    parts = [rows for _, rows in pd.concat(blobs).sort_values("part").groupby("part")]
    tracemalloc.reset_peak()
    for rows in steps[1](iter([pd.concat(parts)])):
        pairs.append(rows)
    peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    seen = Counter(p for t in texts for p in zip(["", *t.split()], [*t.split(), ""], strict=True))
    assert Counter(pd.concat(pairs)["c"].tolist()) == Counter(c for c in seen.values() if c > 1)
    assert peaks[0] < 80e6, peaks


def test_steps_of_the_near_duplicate_stage_give_memory_back(spark):
    steps = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, handle, _):
            steps.append(handle)
            return self

        mapInPandas, repartition, sortWithinPartitions, where = mapInArrow, select, select, select

    simhash.shingle_table(Rows(), 5, 0.8)
    similarity.prefix_rows(Rows(), 0.8)
    similarity.candidates(Rows(), 0.8)
    similarity.with_large_signatures(Rows())
    assert [s.__qualname__.split(".")[0] for s in steps] == ["lean"] * 4
