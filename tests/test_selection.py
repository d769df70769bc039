"""Ranks that don't depend on the order in which numbers are added, and positions of long answers."""

from pyspark.sql import functions as F

from tests import parity
from textloom.operators import corpus, features, select
from textloom.plans import queries as plans

ROWS = "question_id long, answer_id long, answer_pos long, sentence_id int, sentence string, tokens array<string>"


def test_equal_sentences_tie_in_any_order_of_their_words(spark):
    """Sentences of the same values in other orders, at half a unit of the ninth digit: ranked by their places."""
    values = [0.1, 0.2, 0.3, 0.7, 0.000000001]
    words = [f"w{i}" for i in range(5)]
    orders = [words, words[::-1], words[2:] + words[:2], [words[3], words[0], words[4], words[2], words[1]]]
    texts = [*orders, ["x"], ["y"], ["z"], ["x", "y", "z"]]
    rows = spark.createDataFrame([(1, 1, 1, i + 1, " ".join(t), t) for i, t in enumerate(texts)], ROWS).coalesce(1)
    known = spark.createDataFrame([(1, w, v) for w, v in zip(words, values)] + [(1, w, 0.05) for w in "xyz"], "question_id long, term string, value double")
    kept = features.feature_max
    try:
        features.feature_max = lambda weights: known
        got = features.tfidf_scores(rows, mode="none", config=features.TfIdf(ratio_threshold=0.99)).orderBy("sentence_id").collect()
    finally:
        features.feature_max = kept
    assert len({r.raw for r in got[:4]}) == 1 and len({r.score for r in got[:4]}) == 1
    # 1.300000001 over 5 tokens, of a mean of 26 / 8
    assert got[0].raw == 1300000001 * 26 / (8 * 5) / 1e9
    ranks = select.top_sentences(rows.join(features_frame(spark, got), corpus.KEY)).orderBy("sentence_id").collect()
    assert [r["rank"] for r in ranks[:4]] == [1, 2, 3, 4]


def features_frame(spark, rows):
    return spark.createDataFrame([(r.question_id, r.answer_id, r.sentence_id, r.score) for r in rows], "question_id long, answer_id long, sentence_id int, score double")


def test_places_of_an_answer_of_over_ten_thousand_sentences(spark, tmp_path):
    """Positions of the first answer go beyond those of the second one; places follow answers."""
    long = " ".join(f"Word{i % 7} other{i % 5} thing." for i in range(10_020))
    spark.createDataFrame([(1, 0, "user", "Which word?"), (1, 1, "assistant", long), (1, 2, "assistant", "Word1 other2. Thing word3. Next word4.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = parity.connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    rows = corpus.sentences(corpus.answers(spark.read.parquet(f"{tmp_path}/conversations.parquet")))
    kept = select.fill_gaps
    try:
        select.fill_gaps = lambda chosen: rows
        got = plans.queries()["position_order"](spark, str(tmp_path)).orderBy("place").collect()
    finally:
        select.fill_gaps = kept
    assert [(r.answer_id, r.sentence_id) for r in got] == sorted((r.answer_id, r.sentence_id) for r in got) and len(got) == 10_023
