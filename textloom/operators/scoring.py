"""Sentence scorers that compare with the question, and the fusion of all scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import Fusion, KeywordRatio
from ..functions.similarity import keyword_dice
from .corpus import KEY
from .features import minmax


def keyword_ratio(sentence_rows: DataFrame, keyword_rows: DataFrame, config: KeywordRatio = KeywordRatio()) -> DataFrame:
    """(keys, raw, score): weight of the sentence's items that match a keyword over that weight and the unmatched items.

    Items are the entities, repeats included, and the tokens that aren't among them, once each. An item takes the largest weight of the
    keywords with a word overlap of the threshold or more; such keywords share a word, which is what the join is on.
    """
    items = F.concat("ners", F.array_distinct(F.filter("tokens", lambda t: ~F.array_contains("ners", t))))
    rows = sentence_rows.select(*KEY, F.explode(items).alias("item"))
    words = lambda df, c: df.select("question_id", c).distinct().select("question_id", c, F.explode(F.array_distinct(F.split(c, " "))).alias("word"))
    pairs = words(rows, "item").join(words(keyword_rows, "keyword"), ["question_id", "word"]).select("question_id", "item", "keyword").distinct()
    near = pairs.where(keyword_dice(F.col("item"), F.col("keyword")) >= config.keyword_threshold).join(keyword_rows, ["question_id", "keyword"])
    weights = near.groupBy("question_id", "item").agg(F.max("weight").alias("weight"))
    sums = rows.join(weights, ["question_id", "item"], "left").groupBy(*KEY).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("hit"), F.sum(F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(0.0)).alias("missed"))
    raw = F.coalesce(F.col("hit") / (F.col("hit") + F.col("missed")), F.lit(0.0))
    return by_answer_top(sentence_rows.select(*KEY).join(sums, KEY, "left").select(*KEY, raw.alias("raw")))


def by_answer_top(rows: DataFrame) -> DataFrame:
    """Adds score: raw over the answer's maximum (if not 0), then min-max within the answer."""
    top = F.max("raw").over(W.partitionBy(*KEY[:2]))
    scaled = rows.withColumn("scaled", F.when(top != 0, F.col("raw") / top).otherwise(F.col("raw")))
    return scaled.withColumn("score", minmax(F.col("scaled"), KEY[:2])).drop("scaled")


def word_mover(sentence_rows: DataFrame, tagged: DataFrame, keyword_rows: DataFrame, vocabulary: DataFrame, vectors: DataFrame | None = None, extensions: DataFrame | None = None) -> DataFrame:
    """(keys, raw, score): relaxed word-mover similarity of the question's words to each sentence.

    The question's words (and extensions) that some sentence of the question holds count with the weight of the first
    keyword that contains them, times their vocabulary weight; each contributes its largest cosine with a word of the
    sentence. vectors(token, vec) gives the cosines; without it equal words have 1 and others 0.
    """
    asked = tagged.select("question_id", F.explode("nouns").alias("q"))
    if extensions is not None:
        asked = asked.unionByName(extensions.select("question_id", F.col("token").alias("q"))).distinct()
    words = sentence_rows.select(*KEY, F.explode(F.array_distinct("tokens")).alias("term"))
    asked = asked.join(words.select("question_id", F.col("term").alias("q")).distinct(), ["question_id", "q"], "left_semi")
    first = asked.join(keyword_rows, "question_id").where(F.instr("keyword", F.col("q")) > 0).groupBy("question_id", "q").agg(F.min_by("weight", "kw_pos").alias("kw"))
    weighted = asked.join(first, ["question_id", "q"]).join(vocabulary.select("question_id", F.col("term").alias("q"), F.col("weight").alias("v")), ["question_id", "q"]).select("question_id", "q", (F.col("kw") * F.col("v")).alias("w"))
    total = weighted.groupBy("question_id").agg(F.sum("w").alias("all"))
    if vectors is None:
        best = words.join(weighted, (words.question_id == weighted.question_id) & (words.term == weighted.q)).select(words.question_id, "answer_id", "sentence_id", F.col("w").alias("part"))
    else:
        from ..functions.similarity import cosine

        pairs = weighted.select("question_id", "q").join(words.select("question_id", "term").distinct(), "question_id").select("q", "term").distinct()
        sims = pairs.join(vectors.select(F.col("token").alias("q"), F.col("vec").alias("qv")), "q").join(vectors.select(F.col("token").alias("term"), F.col("vec").alias("tv")), "term").select("q", "term", cosine(F.col("qv"), F.col("tv")).alias("sim")).where("sim > 0")
        best = words.join(sims, "term").join(weighted, ["question_id", "q"]).groupBy(*KEY, "q").agg((F.max("sim") * F.max("w")).alias("part"))
    sums = best.groupBy(*KEY).agg(F.sum("part").alias("hit"))
    rows = sentence_rows.select(*KEY).join(sums, KEY, "left").join(total, "question_id", "left")
    return by_answer_top(rows.select(*KEY, F.when(F.coalesce("all", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("hit", F.lit(0.0)) / F.col("all")).alias("raw")))


def weighted_overlap(sentence_rows: DataFrame, tagged: DataFrame, vocabulary: DataFrame, option: str = "max", entity_weight: float = 0.0) -> DataFrame:
    """(keys, raw): larger (or mean) share of weight that a sentence and its question have in common; 0 if either has none."""
    sen = sentence_rows.select(*KEY, F.explode("tokens").alias("term")).groupBy(*KEY, "term").agg(F.count(F.lit(1)).alias("tf"))
    que = tagged.select("question_id", F.explode("tokens").alias("term")).groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    sw = sen.join(vocabulary, ["question_id", "term"]).join(que, ["question_id", "term"], "left")
    qn = que.join(vocabulary, ["question_id", "term"]).groupBy("question_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("n2"))
    sums = sw.groupBy(*KEY).agg(
        F.sum(F.col("tf") * F.col("weight")).alias("n1"), F.sum(F.when(F.col("qtf").isNotNull(), F.col("tf") * F.col("weight")).otherwise(0.0)).alias("s1"), F.sum(F.coalesce(F.col("qtf") * F.col("weight"), F.lit(0.0))).alias("s2")
    )
    rows = sentence_rows.select(*KEY, F.col("ners").alias("sn")).join(sums, KEY, "left").join(qn, "question_id", "left").join(tagged.select("question_id", F.col("ners").alias("qn")), "question_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n1, s1, n2, s2 = (zero(F.col(c)) for c in ("n1", "s1", "n2", "s2"))
    if entity_weight:
        held = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(b, x))) * entity_weight
        s1, s2 = s1 + held("sn", F.col("qn")), s2 + held("qn", F.col("sn"))
        n1, n2 = n1 + F.size("sn") * entity_weight, n2 + F.size("qn") * entity_weight
    a, b = s1 / n1, s2 / n2
    raw = F.when(n1 * n2 == 0, 0.0).otherwise(F.greatest(a, b) if option.lower() == "max" else (a + b) / 2)
    return rows.select(*KEY, raw.alias("raw"))


def query_score(rows: DataFrame) -> DataFrame:
    """Adds score to (keys, raw): min-max within the question, then within the answer."""
    return rows.withColumn("by_question", minmax(F.col("raw"), ["question_id"])).withColumn("score", minmax(F.col("by_question"), KEY[:2])).drop("by_question")


def fused(parts: dict[str, Column], weights: Fusion = Fusion()) -> Column:
    """Weighted mean of the five scores."""
    return sum((getattr(weights, k) * c for k, c in parts.items()), F.lit(0.0)) / weights.total


def fuse(scores: dict[str, DataFrame], weights: Fusion = Fusion()) -> DataFrame:
    """(keys, tfidf, lexrank, keyword, mover, query, final): one join on the keys, final min-max within the question."""
    out = None
    for name, df in scores.items():
        one = df.select(*KEY, F.col("score").alias(name))
        out = one if out is None else out.join(one, KEY)
    return out.withColumn("final", minmax(fused({k: F.col(k) for k in scores}, weights), ["question_id"]))


SCORE_COLUMNS = {"final": "final", "tfidf": "tfidf", "lexrank": "lexrank", "query_base": "query", "ner": "keyword", "wRWMD": "mover"}


def score_column(kind: str) -> str:
    """Column of a score kind."""
    if kind not in SCORE_COLUMNS:
        raise ValueError(f"unknown score {kind!r}; one of {', '.join(SCORE_COLUMNS)}")
    return SCORE_COLUMNS[kind]
