"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_ANSWER = T.StructType([T.StructField(n, T.StringType()) for n in ("article", "answer_abs_summ", "answer_ext_summ", "section", "url", "rating")])
RAW_QUESTION = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answers", T.MapType(T.StringType(), RAW_ANSWER)),
        T.StructField("multi_abs_summ", T.StringType()),
        T.StructField("multi_ext_summ", T.StringType()),
    ]
)
SCORES = T.StructType(
    [T.StructField("question_id", T.LongType()), T.StructField("answer_id", T.LongType()), T.StructField("sentence_id", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("tfidf", "lexrank", "query_base", "keyword", "mover", "final")]
)
SENTENCE_KEY = ["question_id", "answer_id", "sentence_id"]
