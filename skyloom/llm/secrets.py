"""Operator 4: secret scans over an incremental blob ledger (built-in functions only).

A text is addressed by its SHA-256. The ledger is a Parquet table with a row for every blob and the rule versions that one
run has scanned it by, with the findings, none included. A run (`scan_into`) scans only the pairs of blob and rule version
that the ledger lacks, each distinct text once however many documents or versions hold it, appends them, and joins the
ledger's findings back to every document (path) of the blob. A finding names its rule version: those of versions that are
no longer current are left out, so a changed rule replaces its old findings.

Only texts that pass a rule's cheap test are shuffled (to take each blob once); the others move as their hash alone.

A rule's matches are leftmost and non-overlapping; those whose captured group is too short are dropped afterwards, so a
failed match still consumes its text. Places come from lengths: the pieces between matches and the matches alternate.

Defined results: a null text is the empty text; places count code points, end exclusive; a null doc_id keeps its row;
repeated rows get equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import discard, pick, shared_dir, small, stored, table

#: kind, version, pattern, group whose length counts, least length, cheap test that a text must pass. In the order of kinds.
RULES = (
    ("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    ("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    ("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY"),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    ("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_"),
    ("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, "xox"),
)
BASE = ("assign", "access", "hex")
ORDER = {r[0]: i for i, r in enumerate(RULES)}
FINDING = "array<struct<start:long,rank:int,stop:long,kind:string,rule:string>>"
LEDGER = f"blob binary, rules array<string>, findings {FINDING}"


def rule_key(rule: tuple) -> str:
    return f"{rule[0]}@{rule[1]}"


def passes(rule: tuple) -> Column:
    """The cheap test of a rule on the column text."""
    return F.rlike("text", F.lit(rule[5])) if any(c in rule[5] for c in "[(?") else F.contains("text", F.lit(rule[5]))


def scan(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Findings (blob, todo, kind, start, stop) of distinct texts (blob, text, todo), by the rules whose key is in `todo`.

    A blob without findings has a row with null kind, so that the ledger can say that it has been scanned.
    """

    def measured(rule: tuple):
        kind, _, pattern, group, least, _ = rule
        due = F.array_contains("todo", rule_key(rule)) & passes(rule)
        lengths = F.arrays_zip(
            F.transform(F.split("text", pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.length).alias("len"),
            F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), F.length).alias("part"),
        )
        return F.when(due, F.transform(lengths, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(least).alias("least"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["part"].alias("part"))))

    found = None
    for rule in rules:
        one = F.coalesce(measured(rule), F.array().cast("array<struct<kind:string,least:int,i:int,gap:int,len:int,part:int>>"))
        found = one if found is None else F.concat(found, one)
    rows = blobs.select("blob", "todo", F.explode_outer(found).alias("m")).select("blob", "todo", "m.*")
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    right = F.col("part") >= F.col("least")
    placed = rows.withColumn("stop", end.cast("long"))
    return placed.select("blob", "todo", F.when(right, F.col("kind")).alias("kind"), (F.col("stop") - F.col("len")).alias("start"), "stop")


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """New ledger rows (blob, rules, findings) for the texts of `docs`: what `ledger` has not seen under these rules.

    `findings` are sorted by start, then by the order of the rules. Append the rows to the ledger's table.
    """
    keys = F.array(*[F.lit(rule_key(r)) for r in rules])
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    worth = reduce(or_, [passes(r) for r in rules], F.lit(False))
    blobs = text.select(F.unhex(F.sha2("text", 256)).alias("blob"), F.when(worth, F.col("text")).alias("text")).groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text"))
    if ledger is None:
        due = blobs.withColumn("todo", keys)
    else:
        done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        due = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    rank, rule = (F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("kind")) for table in (ORDER, {r[0]: rule_key(r) for r in rules}))
    one = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "stop", "kind", rule.alias("rule")))
    return scan(due, rules).groupBy("blob").agg(F.first("todo").alias("rules"), F.sort_array(F.filter(F.collect_list(one), lambda x: x.isNotNull())).cast(FINDING).alias("findings"))


def findings_by_path(docs: DataFrame, ledger: DataFrame, rules: tuple = RULES) -> DataFrame:
    """`docs` with the ledger's findings of their blob by the current versions of the rules, each once."""
    current = F.filter(F.array_distinct(F.flatten(F.collect_list("findings"))), lambda x: x["rule"].isin(*[rule_key(r) for r in rules]))
    hits = ledger.where(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(current).alias("_findings"))
    keyed = docs.withColumn("_blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    joined = keyed.join(small(stored(hits.withColumnRenamed("blob", "_blob"), "hits"), items=F.size("_findings")), "_blob", "left")
    return joined.select(*docs.columns, F.coalesce("_findings", F.array().cast(FINDING)).alias("findings"))


def scan_into(docs: DataFrame, path: str, rules: tuple = RULES) -> DataFrame:
    """`docs` with their findings; what the ledger at `path` (made if it is not there) lacks is scanned and appended first."""
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    new = stored(scan_new(docs, spark.read.schema(LEDGER).parquet(path), rules), "scanned")
    new.write.mode("append").parquet(path)
    discard(new)
    return findings_by_path(docs, spark.read.schema(LEDGER).parquet(path), rules)


def written(findings) -> F.Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """The documents' spans. `ledger` is the path of a ledger that runs share; without one the run makes its own, in the shared folder."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = scan_into(docs, ledger or f"{shared_dir(spark).rstrip('/')}/skyloom/ledger-{uuid.uuid4().hex}")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"))


def sql() -> str:
    parts = []
    for kind, _, pattern, group, least, _ in RULES:
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, text, '{kind}' AS kind, {ORDER[kind]} AS rank, {least} AS least, regexp_extract_all(text, '{p}', 0) AS m,
         regexp_extract_all(text, '{p}', {group}) AS part, regexp_split_to_array(text, '{p}') AS gap FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), r AS ({" UNION ALL ".join(parts)}
), f AS (
  SELECT doc_id, text, kind, rank, list_sum(list_transform(gap[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS start, len(m[i]) AS len
  FROM r, unnest(generate_series(1, len(m))) AS g(i) WHERE len(part[i]) >= least
), s AS (
  SELECT DISTINCT doc_id, text, kind, rank, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + len AS BIGINT) AS span FROM f
), a AS (
  SELECT doc_id, text, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id AND d.text = a.text
"""
