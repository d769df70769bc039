"""Term weights: smoothed and plain inverse document frequencies, TF-IDF, and scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import TfIdf
from .corpus import KEY, term_counts
from .storage import materialize


def minmax(value: Column, by: list[str]) -> Column:
    """(value - min) / (max - min) over a group, the maximum taken with 0 and the minimum with 1e9; 1 if they are equal."""
    w = W.partitionBy(*by)
    v = F.round(value, 9)
    top, low = F.greatest(F.max(v).over(w), F.lit(0.0)), F.least(F.min(v).over(w), F.lit(1e9))
    return F.when(top == low, 1.0).otherwise((v - low) / (top - low))


def smoothed_idf(counts: DataFrame, sizes: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, term, df, n, idf), idf = ln((1 + n) / (1 + df)) + 1; counts: one row per document and term; sizes: scope, n."""
    df = counts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(sizes, scope).withColumn("idf", F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1)


def question_sizes(sentence_rows: DataFrame) -> DataFrame:
    """Sentences per question, those without tokens too."""
    return sentence_rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


def tfidf(sentence_rows: DataFrame) -> DataFrame:
    """(question_id, answer_id, sentence_id, term, tfidf): rows of length 1 within a question's vocabulary."""
    tf = term_counts(sentence_rows)
    idf = smoothed_idf(tf, question_sizes(sentence_rows), ["question_id"])
    raw = tf.join(idf.select("question_id", "term", "idf"), ["question_id", "term"]).withColumn("raw", F.col("tf") * F.col("idf"))
    return raw.withColumn("tfidf", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*KEY)))).select(*KEY, "term", "tfidf")


def feature_max(weights: DataFrame) -> DataFrame:
    """(question_id, term, value): a term's largest weight."""
    return weights.groupBy("question_id", "term").agg(F.round(F.max("tfidf"), 12).alias("value"))


def rank_threshold(features: DataFrame, ratio: float = 0.7) -> DataFrame:
    """(question_id, threshold): the value at place int(V * ratio) of the descending values, counted from 0.

    A ratio of 1 has no such place and gives no row.
    """
    ranked = features.withColumn("rn", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("value"), "term"))).withColumn("v", F.count(F.lit(1)).over(W.partitionBy("question_id")))
    return ranked.where(F.col("rn") == F.floor(F.col("v") * F.lit(ratio)) + 1).select("question_id", F.col("value").alias("threshold"))


def tfidf_scores(sentence_rows: DataFrame, keyword_rows: DataFrame | None = None, tagged: DataFrame | None = None, config: TfIdf = TfIdf(), mode: str | None = None) -> DataFrame:
    """(keys, raw, score): sum of the terms' feature values, boosted by keywords, that reach the question's threshold.

    Mode `weight` multiplies by the weight of the first keyword that holds the term and is among the sentence's tokens or
    entities; mode `ner` adds a constant if any question entity holds the term; mode `none` boosts nothing. The sum is
    divided by how much longer than the mean the sentence is; sentences without terms score 0.
    """
    mode = mode or config.keywords_type
    features = materialize(sentence_rows.sparkSession, feature_max(tfidf(sentence_rows)), "term-values")  # for the terms and the threshold
    terms = sentence_rows.select(*KEY, F.explode(F.array_distinct("tokens")).alias("term")).join(features, ["question_id", "term"])
    value = F.col("value")
    if mode == "weight":
        lemmas = sentence_rows.select(*KEY, F.explode(F.array_distinct(F.concat("tokens", "ners"))).alias("keyword"))
        present = lemmas.join(keyword_rows, ["question_id", "keyword"])
        boosts = terms.join(present, KEY).where(F.instr("keyword", F.col("term")) > 0).groupBy(*KEY, "term").agg(F.min_by("weight", "kw_pos").alias("weight"))
        terms = terms.join(boosts, [*KEY, "term"], "left")
        value = value * F.coalesce("weight", F.lit(1.0))
    elif mode == "ner":
        terms = terms.join(tagged.select("question_id", F.col("ners").alias("entities")), "question_id", "left")
        held = F.coalesce(F.exists("entities", lambda n: F.instr(n, F.col("term")) > 0), F.lit(False))
        value = value + F.when(held, config.keywords_boost).otherwise(0.0)
    cut = terms.withColumn("boosted", F.round(value, 9)).join(rank_threshold(features, config.ratio_threshold), "question_id")
    # whole billionths, whose sum and quotient don't depend on the order of rows: equal sentences tie, also at half a unit of the ninth digit
    units = F.round(F.col("boosted") * 1e9)
    sums = cut.groupBy(*KEY).agg(F.sum(F.when(F.col("boosted") >= F.round("threshold", 9), units).otherwise(0.0)).alias("total"), F.count(F.lit(1)).alias("length"))
    w = W.partitionBy("question_id")
    rows = sentence_rows.select(*KEY, F.sum(F.size("tokens")).over(w).cast("double").alias("all"), F.count(F.lit(1)).over(w).cast("double").alias("n")).join(sums, KEY, "left")
    long = F.col("n") * F.coalesce("length", F.lit(0))
    raw = F.coalesce(F.when(long > F.col("all"), F.col("total") * F.col("all") / long).otherwise(F.col("total")) / 1e9, F.lit(0.0))
    return rows.select(*KEY, raw.alias("raw")).withColumn("score", minmax(F.col("raw"), KEY[:2]))


def inverse_idf(sentence_rows: DataFrame, question_rows: DataFrame | None = None) -> DataFrame:
    """(question_id, term, weight): 1 / smoothed idf over a question's sentences, the question itself as one more if given."""
    docs = sentence_rows.select("question_id", "answer_id", "sentence_id", F.transform("tokens", F.lower).alias("tokens"))
    if question_rows is not None:
        docs = docs.unionByName(question_rows.select("question_id", F.lit(-1).cast("long").alias("answer_id"), F.lit(0).alias("sentence_id"), F.transform("tokens", F.lower).alias("tokens")))
    idf = smoothed_idf(term_counts(docs), question_sizes(docs), ["question_id"])
    return idf.select("question_id", "term", (1 / F.col("idf")).alias("weight"))


def rank_idf(sentence_rows: DataFrame, tokens: str = "rank_tokens", per_question: bool = False) -> DataFrame:
    """(term, df, n, idf), idf = ln(n / df): a document is an answer with tokens, of all questions or of each."""
    scope = ["question_id"] if per_question else []
    terms = sentence_rows.select("question_id", "answer_id", F.explode(tokens).alias("term")).distinct()
    n = terms.select("question_id", "answer_id").distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    both = df.join(n, scope) if scope else df.crossJoin(F.broadcast(n))  # n is one row
    return both.withColumn("idf", F.log(F.col("n") / F.col("df")))
