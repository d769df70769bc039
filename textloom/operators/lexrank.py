"""Graph centrality of sentences.

Edges join sentences of one question by their idf-modified cosine. Rows of the transition matrix are a node's edges
divided by their sum, and as similarity is symmetric the power method from all ones ends at
component size * row sum / sum of row sums, which is computed directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import LexRank
from .corpus import KEY, term_counts
from .features import minmax, rank_idf, smoothed_idf, question_sizes
from .graph import connected_components
from .storage import materialize
from ..functions.text import rank_tokens


def weighted_terms(sentence_rows: DataFrame, per_question: bool = False) -> DataFrame:
    """(question_id, node, term, w): tf * idf of the ranking tokens, terms without weight left out; node is (answer_id, sentence_id)."""
    rows = sentence_rows.withColumn("rank_tokens", rank_tokens(F.col("normalized")))
    idf = rank_idf(rows, per_question=per_question)
    on = ["question_id", "term"] if per_question else ["term"]
    return term_counts(rows, "rank_tokens").join(idf.select(*on, "idf"), on).where("idf > 0").select("question_id", F.struct("answer_id", "sentence_id").alias("node"), "term", (F.col("tf") * F.col("idf")).alias("w"))


def similarities(terms: DataFrame, boost: DataFrame | None = None) -> DataFrame:
    """(question_id, a, b, sim), a < b: the pairs that share a weighted term. boost(question_id, term, weight) multiplies products."""
    norms = terms.groupBy("question_id", "node").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    left = terms.select("question_id", "term", F.col("node").alias("a"), F.col("w").alias("wa"))
    if boost is not None:
        left = left.join(boost, ["question_id", "term"], "left").withColumn("wa", F.col("wa") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    right = terms.select("question_id", "term", F.col("node").alias("b"), F.col("w").alias("wb"))
    products = left.join(right, ["question_id", "term"]).where("a < b").groupBy("question_id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    at = lambda c: norms.select("question_id", F.col("node").alias(c), F.col("norm").alias(f"n{c}"))
    return products.join(at("a"), ["question_id", "a"]).join(at("b"), ["question_id", "b"]).select("question_id", "a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 12).alias("sim"))


def stationary(spark: SparkSession, sentence_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(keys, component, raw): edges(question_id, a, b, w) of positive weight; every sentence has an edge of 1 to itself."""
    edges = materialize(spark, edges, "sentence-edges")
    key = lambda c: F.struct("question_id", F.col(c).alias("node"))
    roots = connected_components(spark, edges.select(key("a").alias("u"), key("b").alias("v")), "sentence-components")
    roots = roots.select(F.col("node.question_id").alias("question_id"), F.col("node.node").alias("node"), F.col("root.node").alias("component"))
    weights = edges.select("question_id", F.col("a").alias("node"), "w").unionByName(edges.select("question_id", F.col("b").alias("node"), "w")).groupBy("question_id", "node").agg(F.sum("w").alias("w"))
    nodes = sentence_rows.select("question_id", F.struct("answer_id", "sentence_id").alias("node"))
    rows = nodes.join(weights, ["question_id", "node"], "left").join(roots, ["question_id", "node"], "left")
    rows = rows.select("question_id", "node", (F.coalesce("w", F.lit(0.0)) + 1).alias("w"), F.coalesce("component", "node").alias("component"))
    sums = rows.groupBy("question_id", "component").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    return rows.join(sums, ["question_id", "component"]).select("question_id", "node.answer_id", "node.sentence_id", "component", (F.col("n") * F.col("w") / F.col("total")).alias("raw"))


def lexrank(spark: SparkSession, sentence_rows: DataFrame, config: LexRank = LexRank()) -> DataFrame:
    """(keys, component, raw, score): closed-form centrality, then min-max per answer. Threshold None weighs edges by similarity."""
    sims = similarities(materialize(spark, weighted_terms(sentence_rows, not config.all_questions), "sentence-terms"))
    if config.threshold is None:
        edges = sims.where("sim > 0").withColumn("w", F.col("sim"))
    else:
        edges = sims.where(F.col("sim") > config.threshold).withColumn("w", F.lit(1.0))
    return stationary(spark, sentence_rows, edges.drop("sim")).withColumn("score", minmax(F.col("raw"), KEY[:2]))


def keyword_terms(sentence_rows: DataFrame) -> DataFrame:
    """(question_id, node, term, w) of the variant: tf / smoothed idf of content tokens within a question."""
    tf = term_counts(sentence_rows)
    idf = smoothed_idf(tf, question_sizes(sentence_rows), ["question_id"])
    return tf.join(idf.select("question_id", "term", "idf"), ["question_id", "term"]).select("question_id", F.struct("answer_id", "sentence_id").alias("node"), "term", (F.col("tf") / F.col("idf")).alias("w"))


def keyword_lexrank(spark: SparkSession, sentence_rows: DataFrame, keyword_rows: DataFrame, config: LexRank = LexRank()) -> DataFrame:
    """The variant with keyword-weighted similarity; still symmetric, so the same closed form holds."""
    sims = similarities(materialize(spark, keyword_terms(sentence_rows), "sentence-terms"), keyword_rows.select("question_id", F.col("keyword").alias("term"), "weight"))
    edges = sims.where(F.col("sim") > (config.threshold or 0.0)).withColumn("w", F.col("sim") if config.threshold is None else F.lit(1.0))
    return stationary(spark, sentence_rows, edges.drop("sim")).withColumn("score", minmax(F.col("raw"), KEY[:2]))
