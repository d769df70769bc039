"""Questions, answers, sentences and keywords from conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .storage import spread

KEY = ["question_id", "answer_id", "sentence_id"]


def questions(conversations: DataFrame) -> DataFrame:
    """(question_id, question): the first user turn of every conversation that has an assistant turn."""
    first = conversations.where("role = 'user'").groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("question"))
    return first.join(conversations.where("role = 'assistant'").select(F.col("conv_id").alias("question_id")).distinct(), "question_id", "left_semi")


def answers(conversations: DataFrame) -> DataFrame:
    """(question_id, answer_id, answer_pos, article) of the assistant turns of conversations with a user turn."""
    asked = conversations.where("role = 'user'").select(F.col("conv_id").alias("question_id")).distinct()
    rows = conversations.where("role = 'assistant'").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("answer_id"), F.col("turn").alias("answer_pos"), F.col("text").alias("article"))
    return rows.join(asked, "question_id", "left_semi")


def sentences(answer_rows: DataFrame, merge: bool = False) -> DataFrame:
    """One row per sentence, numbered from 1 within its answer, with its normalised form, tokens and entities."""
    segs = T.segments(T.clean_html(F.col("article")))
    cut = spread(answer_rows.where("article IS NOT NULL"), "question_id").withColumn("segs", segs).withColumn("segs", T.merge_dangling(F.col("segs")) if merge else T.drop_dangling(F.col("segs")))
    # the outer form, lest a filter on the segments' number be inferred and evaluate them once more beside the scan
    rows = cut.select("question_id", "answer_id", "answer_pos", F.posexplode_outer("segs").alias("sentence_id", "sentence")).where("sentence IS NOT NULL").withColumn("sentence_id", F.col("sentence_id") + 1)
    return prepare(rows)


def prepare(rows: DataFrame, entities: Callable[[Column], Column] = T.adjacent_pairs) -> DataFrame:
    """Adds normalized, tokens and ners to rows(sentence)."""
    return rows.withColumn("normalized", T.normalize(F.col("sentence"))).withColumn("tokens", T.content_tokens(F.col("normalized"))).withColumn("ners", entities(F.col("tokens")))


def question_tokens(question_rows: DataFrame) -> DataFrame:
    """Adds tokens, nouns (distinct tokens, in order) and ners to rows(question)."""
    tagged = question_rows.withColumn("tokens", T.content_tokens(T.normalize(F.col("question"))))
    return tagged.withColumn("nouns", F.array_distinct("tokens")).withColumn("ners", T.adjacent_pairs(F.col("tokens")))


def keywords(tagged: DataFrame, entity_weight: float = 2.0, token_weight: float = 4.0) -> DataFrame:
    """(question_id, kw_pos, keyword, weight): entities first, then nouns; a keyword keeps its first place and largest weight."""
    both = F.concat(F.transform("ners", lambda n: F.struct(n.alias("keyword"), F.lit(float(entity_weight)).alias("weight"))), F.transform("nouns", lambda n: F.struct(n.alias("keyword"), F.lit(float(token_weight)).alias("weight"))))
    rows = tagged.select("question_id", F.posexplode(both).alias("pos", "k")).select("question_id", "pos", "k.*")
    return rows.groupBy("question_id", "keyword").agg(F.min("pos").alias("kw_pos"), F.max("weight").alias("weight")).select("question_id", "kw_pos", "keyword", "weight")


def term_counts(sentence_rows: DataFrame, tokens: str | Column = "tokens", keep: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """(keys, term, tf) over the tokens of each row."""
    return sentence_rows.select(*keep, F.explode(tokens).alias("term")).groupBy(*keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def merged(sentence_rows: DataFrame) -> DataFrame:
    """All sentences of a question as one answer, renumbered from 1 in answer order."""
    from pyspark.sql import Window as W

    return sentence_rows.withColumn("merged_id", F.row_number().over(W.partitionBy("question_id").orderBy("answer_pos", "sentence_id")))


def merged_article(sentence_rows: DataFrame) -> DataFrame:
    """(question_id, article): the sentences of a question in order, joined by blanks."""
    listed = F.array_sort(F.collect_list(F.struct("answer_pos", "sentence_id", "sentence")))
    return sentence_rows.groupBy("question_id").agg(F.array_join(F.transform(listed, lambda s: s["sentence"]), " ").alias("article"))


def sort_position(ques: Column, ans: Column, sen: Column) -> Column:
    return ques * 100000000 + ans * 10000 + sen
