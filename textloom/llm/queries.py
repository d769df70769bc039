"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, line_dedup, mixing, quality, url_rules
from .common import table
from .exact_dedup import exact_duplicates
from .secrets_scan import frequent_words, secret_spans, span_digest
from .simhash import simhash_components
from .token_counts import token_counts, vocabulary


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, table(spark, sf_dir, "documents"), shingle=3)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = frequent_words(vocabulary("byte_bpe_50k.json"))
    return span_digest(secret_spans(table(spark, sf_dir, "documents"), words=words))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_simhash_near_dedup, op2_token_counts, op3_url_rules, op4_exact_dedup, op5_quality_classifier,
            op6_line_dedup, op7_decontaminate, op8_mix_sources, op9_secret_scan, op10_language_id,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_rules": url_rules.ORACLE_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op6_line_dedup": line_dedup.ORACLE_SQL,
        "op7_decontaminate": decontaminate.ORACLE_SQL,
        "op8_mix_sources": mixing.oracle_sql(),
    }
