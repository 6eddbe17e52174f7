"""Operator 10: license scans as an exact set-similarity join of text blocks and license templates (built-ins only).

A template is the wording of a license, of a passage of it or of its usual notice. A block for a template of m words is any
run of m consecutive words of a document, line breaks or not. It matches if it holds `threshold` of the template's distinct
tokens, all its deciding tokens (a version, nc, sa, nd) and none of those that belong to a sibling license.

The join goes over the documents' token sets first: tokens are ordered by the number of documents that hold them, rarest
first. A template with n tokens must share `need` = ceil(threshold * n) of them with a block, and so with its document: at
least one of its n - need + 1 rarest tokens is in the document (prefix filter), documents with fewer than `need` known
tokens cannot qualify (length filter), and from a first common token at places i and j at most the shorter rest can follow
(positional filter). Only documents that pass are cut into blocks, and every block that starts with one of the template's
tokens is verified; a block that starts with another word holds no more than the next that does. So every block that
meets the threshold is found. The templates are constants of the operator; the driver sees a count for each of their words.

Besides, the four base phrases are looked up at every place where their words stand consecutively, in the documents that
hold all their words.

Defined results: a null text is the empty text; without a find the places are null, the labels empty and the score 0;
a base label scores 1, a template its containment, a document its best; documents equal in id and text give equal rows;
a null doc_id keeps its row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import ALNUM_GAP, alnum_words, discard, pick, row_key, small, stored, table

THRESHOLD = 0.8
#: Base phrases and labels: fixed values of the query's contract.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label, wording (words of the public license texts and notices), tokens that a block must hold, tokens that it must not hold.
TEMPLATES = (
    ("apache-2.0", "apache license version 2 0", "apache 2 0", ""),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "applicable basis", ""),
    ("gpl-2.0", "gnu general public license version 2", "gnu general 2", "lesser affero"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general 3", "lesser affero"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", "gnu lesser 2 1", "affero"),
    ("lgpl-3.0", "gnu lesser general public license version 3", "gnu lesser 3", "affero"),
    ("agpl-3.0", "gnu affero general public license version 3", "gnu affero 3", "lesser"),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "gnu redistribute 2", "lesser affero",
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu redistribute 3", "lesser affero",
    ),
    ("cc-by-4.0", "cc by 4 0", "cc by 4 0", "nc sa nd"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "cc by sa 4", "nc nd"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "cc by nc 4", "sa nd"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "cc by nd 4", "nc sa"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "cc by nc sa 4", "nd"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "cc by nc nd 4", "sa"),
    ("cc-by-4.0", "creative commons attribution 4 0 international", "creative commons attribution 4", "noncommercial sharealike noderivatives"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international", "creative commons sharealike 4", "noncommercial noderivatives"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", "creative commons noncommercial 4", "sharealike noderivatives"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission granted sublicense", "",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted obtaining", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission fee granted", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary", ""),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither endorse", ""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered domain", ""),
)


def need(tokens: int, threshold: float) -> int:
    return ceil(threshold * tokens - 1e-9)


def vocabulary(templates=TEMPLATES) -> list[str]:
    """The words of all templates and phrases, some hundred."""
    return sorted({w for _, t, must, no in templates for part in (t, must, no) for w in part.split()} | {w for p, _ in PHRASES for w in p.split()})


def token_table(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc (key), doc_id, n_words and the distinct known words of every document."""
    known = F.array(*[F.lit(w) for w in vocabulary(templates)])
    return docs.select(row_key().alias("doc"), "doc_id", alnum_words(F.col("text")).alias("words")).select("doc", "doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect(known, "words").alias("tokens"))


def candidates(tokens: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, t): documents whose token set passes the filters of template number t and holds what a block of it must hold."""
    spark = tokens.sparkSession
    counts = {r[0]: r[1] for r in tokens.select(F.explode("tokens").alias("w")).groupBy("w").count().collect()}  # at most the known words
    rank = {w: i for i, w in enumerate(sorted(vocabulary(templates), key=lambda w: (counts.get(w, 0), w)))}
    prefixes = []
    for t, (_, text, must, _) in enumerate(templates):
        own = sorted(rank[w] for w in set(text.split()))
        least = need(len(own), threshold)
        prefixes += [(t, own, [rank[w] for w in must.split()], i, own[i], least) for i in range(len(own) - least + 1)]
    prefix = spark.createDataFrame(prefixes, "t int, want array<int>, must array<int>, i int, rank int, need int")
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    least = min(need(len(set(t.split())), threshold) for _, t, _, _ in templates)
    sets = tokens.where(F.size("tokens") >= least).select("doc", F.array_sort(F.transform("tokens", lambda w: ranks[w])).alias("have"))
    probes = sets.select("doc", "have", F.posexplode("have").alias("j", "rank"))
    room = F.least(F.size("want") - F.col("i"), F.size("have") - F.col("j"))
    met = probes.join(F.broadcast(prefix), "rank").where((F.size("have") >= F.col("need")) & (room >= F.col("need")))
    shares = F.size(F.array_intersect("have", "want")) >= F.col("need")
    return met.where(shares & (F.size(F.array_intersect("have", "must")) == F.size("must"))).select("doc", "t").distinct()


def block_matches(words: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, label, containment) of the best block for each template of `words` (doc, words, ts)."""
    spark = words.sparkSession
    rows = [(t, label, sorted(set(text.split())), len(text.split()), need(len(set(text.split())), threshold), must.split(), no.split()) for t, (label, text, must, no) in enumerate(templates)]
    wording = spark.createDataFrame(rows, "t int, label string, want array<string>, m int, need int, must array<string>, no array<string>")
    each = words.select("doc", "words", F.explode("ts").alias("t")).join(F.broadcast(wording), "t")
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda s: F.array_contains("want", F.element_at("words", s)))

    def common(s: Column) -> Column:
        block = F.slice("words", s, F.col("m"))
        fits = (F.size(F.array_intersect("must", block)) == F.size("must")) & ~F.arrays_overlap("no", block)
        return F.when(fits, F.size(F.array_intersect("want", block))).otherwise(0)

    best = each.select("doc", "label", "need", F.size("want").alias("n"), F.array_max(F.transform(starts, common)).alias("common"))
    return best.where("common >= need").select("doc", "label", (F.col("common") / F.col("n")).alias("containment"))


def phrase_matches(words: DataFrame) -> DataFrame:
    """doc, n_base, first_word, last_word and base labels of documents that hold a base phrase; `words` has doc and words."""
    spaced = words.select("doc", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("t"))

    def times(phrase: str) -> Column:
        return (F.length("t") - F.length(F.replace("t", F.lit(phrase), F.lit("")))) / len(phrase)

    def words_before(chars: Column) -> Column:
        head = F.substring(F.col("t"), F.lit(1), chars)
        return ((F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / 2).cast("long")

    each = []
    for text, label in PHRASES:
        phrase = f" {text.replace(' ', '  ')} "
        first = F.locate(phrase, F.col("t")) - 1
        last = F.length("t") - F.length(F.substring_index("t", phrase, -1)) - len(phrase)
        each.append(F.when(first >= 0, F.struct(F.lit(label).alias("label"), times(phrase).cast("long").alias("n"), words_before(first).alias("first"), words_before(last).alias("last"))))
    found = spaced.select("doc", F.filter(F.array(*each), lambda x: x.isNotNull()).alias("f")).where(F.size("f") > 0)
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return found.select("doc", total.alias("n_base"), F.array_min(F.transform("f", lambda x: x["first"])).alias("first_word"), F.array_max(F.transform("f", lambda x: x["last"])).alias("last_word"), F.transform("f", lambda x: x["label"]).alias("base"))


def licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each of `docs` (doc_id, text): doc (key of id and text), doc_id, n_words, n_base, first_word, last_word, base (labels), labels (all) and score."""
    tokens = stored(token_table(docs, templates), "tokens")
    by_template = candidates(tokens, templates, threshold).groupBy("doc").agg(F.collect_set("t").alias("ts"))
    phrase = F.exists(F.array(*[F.array(*[F.lit(w) for w in p.split()]) for p, _ in PHRASES]), lambda p: F.size(F.array_except(p, "tokens")) == 0)
    none = F.array().cast("array<string>")
    asked = tokens.where(phrase).select("doc").distinct().join(by_template, "doc", "full").select(F.col("doc").alias("_asked"), F.coalesce("ts", F.array().cast("array<int>")).alias("ts"))
    asked = stored(asked, "asked")
    keyed = docs.select(row_key().alias("doc"), "text").join(small(asked, items=F.size("ts") + 1), F.col("doc") == F.col("_asked"))
    words = stored(keyed.dropDuplicates(["doc"]).select("doc", "ts", alnum_words(F.col("text")).alias("words")), "words")
    own = block_matches(words, templates, threshold).groupBy("doc").agg(F.array_distinct(F.collect_set("label")).alias("own"), F.max("containment").alias("best"))
    found = stored(phrase_matches(words).join(own, "doc", "full"), "licenses").select(
        F.col("doc").alias("_doc"), "n_base", "first_word", "last_word", F.coalesce("base", none).alias("base"), F.coalesce("own", none).alias("own"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("best")).alias("score")
    )
    discard(asked)
    return tokens.join(small(found), F.col("doc") == F.col("_doc"), "left").select(
        "doc", "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_sort(F.coalesce("base", none)).alias("base"), F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("own", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    lists = lambda words: f"{words!r}::VARCHAR[]"
    templates = ", ".join(
        f"('{label}', {lists(sorted(set(t.split())))}, {len(t.split())}, {need(len(set(t.split())), THRESHOLD)}, {lists(must.split())}, {lists(no.split())})" for label, t, must, no in TEMPLATES
    )
    return f"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array({low}, '{ALNUM_GAP}'), lambda x: x <> '') AS words FROM documents
), p(words, label) AS (VALUES {phrases}), t(label, want, m, need, must, no) AS (VALUES {templates}), b AS (
  SELECT d.doc_id, d.text, p.label, s - 1 AS place
  FROM d, p, unnest(generate_series(1, len(d.words) - len(p.words) + 1)) AS g(s) WHERE d.words[s] = p.words[1] AND list_slice(d.words, s, s + len(p.words) - 1) = p.words
), c AS (
  SELECT doc_id, text, words, list_distinct(words) AS once FROM (SELECT DISTINCT * FROM d)
), w AS (
  SELECT doc_id, text, label, want, need, must, no, list_slice(words, s, s + m - 1) AS block
  FROM (SELECT * FROM c JOIN t ON len(list_intersect(c.once, t.must)) = len(t.must) AND len(list_intersect(c.once, t.want)) >= t.need) x, unnest(generate_series(1, len(words))) AS g(s)
  WHERE list_contains(want, words[s])
), m AS (
  SELECT doc_id, text, label, max(len(list_intersect(want, block)) / len(want)) AS share
  FROM w WHERE len(list_intersect(must, block)) = len(must) AND NOT list_has_any(no, block) AND len(list_intersect(want, block)) >= need GROUP BY ALL
), a AS (
  SELECT doc_id, text, count(*) FILTER (place IS NOT NULL) AS n_base, min(place) AS first_word, max(place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place IS NOT NULL) AS base, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT DISTINCT doc_id, text, label, place, 1.0::DOUBLE AS share FROM b UNION ALL SELECT doc_id, text, label, NULL, share FROM m) GROUP BY doc_id, text
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id AND d.text IS NOT DISTINCT FROM a.text
"""
