"""Operator 3: language identification, words first, then ever shorter character n-grams.

A word known from training scores each language by its log frequency there. A word that training has not seen falls
back to its longest character n-grams that are known, from five characters down to one. The model is fitted on a
bounded sample of labelled rows: at most `per_language` documents of each language, those with the smallest hash of
their id, whole texts. It is a few MB, whatever the corpus, and is broadcast to the workers that score whole texts.

Defined results: null texts and texts without letters are `und` with score 0; rows with null lang are scored but not
learned from; a null doc_id counts as the empty text in the split; without labelled rows everything is `und`; ties
between languages go to the first by name; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import discard, lean, pick, remainder, small, stored, table

PER_LANGUAGE, LONGEST, LEAST_COUNT = 1500, 5, 2
#: Letters and numerals that are no decimal digits, such as fractions; `words_of` takes these numerals out.
WORD = re.compile(r"[^\W\d_]+")
#: Words whose scores a worker keeps; words and n-grams that it counts before it sends them.
REMEMBERED, ENTRIES = 100_000, 200_000
REJECT_BELOW = 0.5
digest64 = xxhash.xxh64_intdigest


def words_of(text: str | None) -> Counter:
    """Words of a text, lower-cased, with their counts: runs of characters of the letter categories."""
    found = Counter(WORD.findall(text.lower())) if text else Counter()
    for word in [w for w in found if not w.isalpha()]:
        n = found.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            found[part] += n
    return found


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """text and lang of at most `per_language` documents a language, those with the smallest hashes; of rows with equal hashes all or none."""
    order = Window.partitionBy("lang").orderBy("h")
    keyed = docs.where("lang is not null").withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    first = keyed.select("lang", "h").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language + 1)
    cut = first.groupBy("lang").agg(F.max(F.when(F.col("r") <= per_language, F.col("h"))).alias("cut"), F.max(F.when(F.col("r") > per_language, F.col("h"))).alias("over"))
    return keyed.join(small(stored(cut, "cuts")), "lang").where((F.col("h") <= F.col("cut")) & (F.col("over").isNull() | (F.col("h") < F.col("over")))).select("lang", "text")


#: Languages, and for words (0) and n-grams of each order the sorted hashes of the keys and their log frequencies by language.
#: Arrays only: a worker holds few bytes a key, and no object.
Model = tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]


def hashed(keys: list[str]) -> np.ndarray:
    """Spark's xxhash64 of strings, unsigned."""
    return np.array([digest64(k.encode("utf-8", "surrogatepass"), 42) for k in keys], np.uint64)


def places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `keys` stand in the sorted `known`, and which of them do."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def model_tables(counts: pd.DataFrame) -> Model:
    """The model from rows of (lang, kind, key, n), `key` a hash: plain data that can be broadcast."""
    langs = sorted(counts["lang"].unique())
    tables = []
    for kind in range(LONGEST + 1):
        own = counts[counts["kind"] == kind]
        keys, row = np.unique(own["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        found = np.zeros((len(keys), len(langs)))
        np.add.at(found, (row, np.searchsorted(langs, own["lang"])), own["n"].to_numpy())
        logs = np.log(found + 0.5) - np.log(found.sum(axis=0) + 0.5 * (len(keys) + 1))
        tables.append((keys, logs.astype(np.float32)))
    return langs, tables


def predictor(langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
    """A function from text to (language, score); it remembers the scores of words."""
    row_of: dict[str, int] = {}
    kept = np.zeros((REMEMBERED, len(langs)), np.float32)

    def of_words(words: list[str]) -> np.ndarray:
        at, known = places(tables[0][0], hashed(words))
        out = np.zeros((len(words), len(langs)), np.float32)
        out[known] = tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            parts = [grams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(x) for x in parts])
            at, found = places(tables[n][0], hashed([g for x in parts for g in x]))
            at, owner = at[found], owner[found]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
            if len(first):
                out[left[owner[first]]] = np.add.reduceat(tables[n][1][at], first) / np.diff(np.r_[first, len(owner)])[:, None].astype(np.float32)
                left = np.delete(left, owner[first])
        return out

    def scores_of(words: list[str]) -> np.ndarray:
        row = np.array([row_of.get(w, -1) for w in words], np.int64)
        out, new = kept[row], np.flatnonzero(row < 0).tolist()
        if new:
            out[new] = made = of_words([words[i] for i in new])
            for i, scores in zip(new[: REMEMBERED - len(row_of)], made, strict=False):
                kept[len(row_of)] = scores
                row_of[words[i]] = len(row_of)
        return out

    def predict(text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not langs:
            return "und", 0.0
        mean = np.array(list(words.values()), np.float64) @ scores_of(list(words)).astype(np.float64) / words.total()
        odds = np.exp(2 * (mean - mean.max()))
        best = int(odds.argmax())
        return langs[best], float(odds[best] / odds.sum())

    return predict


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and n-grams of (lang, text) with their counts, sent on whenever `ENTRIES` are held."""
    found: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)

    def sent() -> pd.DataFrame:
        sizes = [len(x) for x in found.values()]
        rows = pd.DataFrame({
            "lang": np.repeat(np.array([lang for lang, _ in found], object), sizes), "kind": np.repeat(np.array([kind for _, kind in found], np.int32), sizes),
            "key": [k for x in found.values() for k in x], "n": np.array([n for x in found.values() for n in x.values()], np.int64),
        })
        found.clear()
        return rows

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for word, n in words_of(text).items():
                found[lang, 0][word] += n
                for order in range(1, LONGEST + 1):
                    own = found[lang, order]
                    for g in grams(word, order):
                        own[g] += n
            if sum(map(len, found.values())) >= ENTRIES:
                yield sent()
    if found:
        yield sent()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Count words and n-grams of the bounded sample in Spark; what occurs once in a language is left to shorter keys."""
    sample = training_sample(docs, per_language)
    counts = sample.mapInPandas(lean(counted), "lang string, kind int, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    often = stored(counts.where(F.col("n") >= LEAST_COUNT).select("lang", "kind", F.xxhash64("key").alias("key"), "n"), "ngrams")
    model = model_tables(often.toArrow().to_pandas())
    discard(often)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def said(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            predict = predictor(*shared.value)
            for texts in parts:
                yield pd.DataFrame([predict(t) for t in texts], columns=["lang_pred", "score"])

        yield from lean(said)(parts)

    return docs.withColumn("_said", of("text")).select(*docs.columns, "_said.lang_pred", "_said.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents without letters (null texts among them) and those that no known language clearly fits.

    Null ids, null languages and repeated rows are judged by their text alone; an empty table stays empty.
    """
    model = fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    return identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= REJECT_BELOW)).select(*docs.columns)
