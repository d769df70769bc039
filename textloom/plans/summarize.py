"""The whole path from conversations to a summary per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings
from ..functions.vectors import hashed_vector
from ..operators import corpus, features, lexrank, mmr, scoring, select
from ..operators.expand import Lexicon, expanded_keywords
from ..operators.ontology import Ontology
from ..operators.storage import materialize

KEY = corpus.KEY


def score_sentences(spark: SparkSession, sentence_rows: DataFrame, tagged: DataFrame, keyword_rows: DataFrame, settings: Settings = Settings(), extensions: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """All scores of every sentence, joined once on the sentence's key.

    extensions(question_id, token) are words that the word mover looks for beside the question's own; vectors(token, vec)
    give its cosines.
    """
    vocabulary = features.inverse_idf(sentence_rows)
    both = features.inverse_idf(sentence_rows, tagged)
    query = scoring.query_score(scoring.weighted_overlap(sentence_rows, tagged, both))
    return scoring.fuse(
        {
            "tfidf": features.tfidf_scores(sentence_rows, keyword_rows, tagged, settings.tfidf),
            "lexrank": lexrank.lexrank(spark, sentence_rows, settings.lexrank),
            "keyword": scoring.keyword_ratio(sentence_rows, keyword_rows, settings.keywords),
            "mover": scoring.word_mover(sentence_rows, tagged, keyword_rows, vocabulary, vectors, extensions),
            "query": query,
        },
        settings.fusion,
    )


def prepared(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentences and tagged questions (written once, as every scorer reads them), and keywords."""
    sentence_rows = materialize(spark, corpus.sentences(corpus.answers(conversations)), "sentences")
    tagged = materialize(spark, corpus.question_tokens(corpus.questions(conversations)), "questions")
    return sentence_rows, tagged, corpus.keywords(tagged)


def summarize(spark: SparkSession, conversations: DataFrame, settings: Settings = Settings(), ontology: Ontology | None = None, lexicon: Lexicon | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, summary). The questions' keywords are expanded by the ontology and the lexicon, as far as they are given."""
    sentence_rows, tagged, _ = prepared(spark, conversations)
    keyword_rows, extensions = expanded_keywords(spark, tagged, ontology, lexicon, settings.expansion)
    keyword_rows, extensions = materialize(spark, keyword_rows, "keywords"), materialize(spark, extensions, "extensions")
    scores = score_sentences(spark, sentence_rows, tagged, keyword_rows, settings, extensions, vectors)
    column = scoring.score_column(settings.single.score)
    chosen = select.fill_gaps(select.top_sentences(sentence_rows.join(scores.select(*KEY, F.col(column).alias("score")), KEY), settings.single))
    merged = corpus.merged(chosen.select("question_id", "answer_id", "answer_pos", "sentence_id", "sentence", "tokens", "ners"))
    queries = tagged.select("question_id", hashed_vector(F.col("tokens")).alias("query_vec"))
    candidates = merged.select("question_id", F.col("merged_id").alias("item"), F.col("merged_id").alias("pos"), F.col("sentence").alias("text"), hashed_vector(F.col("tokens")).alias("vec")).join(queries, "question_id")
    picks = mmr.mmr(candidates, settings.diversity)
    kept = merged.join(picks.select("question_id", F.col("item").alias("merged_id")), ["question_id", "merged_id"])
    return select.post_process(kept, ["answer_pos", "sentence_id"])
