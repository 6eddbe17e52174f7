"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from skyloom.llm import decontaminate, kmeans, language, licenses, lines, mixing, neighbours, ngram_join, paragraphs, periods, pitman_yor, secrets, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.query,
        "op2_substring_dedup": paragraphs.query,
        "op3_language_id": language.query,
        "op4_secret_scan": secrets.query,
        "op5_nearest_neighbours": neighbours.query,
        "op6_lm_scoring": pitman_yor.query,
        "op7_source_mixing": mixing.query,
        "op8_line_dedup": lines.query,
        "op9_simhash_near_dedup": simhash.query,
        "op10_license_scan": licenses.query,
        "op11_ngram_jaccard": ngram_join.query,
        "op12_annulus_clustering": kmeans.query,
        "op13_periodic_runs": periods.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.SQL,
        "op4_secret_scan": secrets.sql(),
        "op7_source_mixing": mixing.SQL,
        "op10_license_scan": licenses.sql(),
        "op11_ngram_jaccard": ngram_join.SQL,
        "op12_annulus_clustering": kmeans.sql(),
    }
