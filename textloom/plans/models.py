"""The five sentence models as objects that are fitted to a corpus and looked up by sentence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..operators import features, lexrank, scoring
from ..operators.storage import materialize
from ..operators.corpus import KEY


@dataclass(frozen=True)
class Corpus:
    """What models learn from: sentences, tagged questions and keywords, as plans.summarize.prepared gives them."""

    sentences: DataFrame
    questions: DataFrame
    keywords: DataFrame


@dataclass(frozen=True)
class Fitted:
    """(keys, raw, score) of all sentences, written once."""

    scores: DataFrame

    def score_of(self, question_id: int, answer_id: int, sentence_id: int) -> float | None:
        """The score of one sentence; None if there is no such sentence."""
        row = self.scores.where((scores_at(question_id, answer_id, sentence_id))).select("score").first()
        return row.score if row else None


def scores_at(question_id: int, answer_id: int, sentence_id: int) -> str:
    return f"question_id = {int(question_id)} AND answer_id = {int(answer_id)} AND sentence_id = {int(sentence_id)}"


@dataclass(frozen=True)
class Model:
    name: str
    score: Callable[[SparkSession, Corpus], DataFrame]

    def fit(self, spark: SparkSession, corpus: Corpus) -> Fitted:
        return Fitted(materialize(spark, self.score(spark, corpus).select(*KEY, "raw", "score"), f"{self.name}-scores"))


def models(settings: Settings = Settings()) -> dict[str, Model]:
    """The models by name, with the settings' parameters."""
    vocabulary = lambda c: features.inverse_idf(c.sentences)
    overlap = lambda c: scoring.weighted_overlap(c.sentences, c.questions, features.inverse_idf(c.sentences, c.questions))
    made = {
        "tfidf": lambda spark, c: features.tfidf_scores(c.sentences, c.keywords, c.questions, settings.tfidf),
        "lexrank": lambda spark, c: lexrank.lexrank(spark, c.sentences, settings.lexrank),
        "keyword": lambda spark, c: scoring.keyword_ratio(c.sentences, c.keywords, settings.keywords),
        "mover": lambda spark, c: scoring.word_mover(c.sentences, c.questions, c.keywords, vocabulary(c)),
        "query": lambda spark, c: scoring.query_score(overlap(c)),
    }
    return {name: Model(name, f) for name, f in made.items()}
