"""ROUGE-1, -2 and -L of pairs of texts, and their averages."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def rouge_tokens(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def _scores(hits: Column, reference: Column, hypothesis: Column) -> list[Column]:
    p = F.when(hypothesis > 0, hits / hypothesis).otherwise(0.0)
    r = F.when(reference > 0, hits / reference).otherwise(0.0)
    return [p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f")]


def rouge_n(pairs: DataFrame, n: int, key: str = "pair_id") -> DataFrame:
    """(key, metric, p, r, f) of pairs(key, reference, hypothesis): overlap of n-grams, each counted as often as both have it."""

    def grams(column: str, count: str) -> DataFrame:
        t = F.col("t")
        listed = F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return pairs.select(key, rouge_tokens(F.col(column)).alias("t")).select(key, F.explode(listed).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias(count))

    both = grams("reference", "nr").join(grams("hypothesis", "nh"), [key, "g"], "full").groupBy(key).agg(
        F.sum(F.least(F.coalesce("nr", F.lit(0)), F.coalesce("nh", F.lit(0)))).alias("hits"), F.sum(F.coalesce("nr", F.lit(0))).alias("nr"), F.sum(F.coalesce("nh", F.lit(0))).alias("nh")
    )
    rows = pairs.select(key).join(both, key, "left").na.fill(0, ["hits", "nr", "nh"])
    return rows.select(key, F.lit(f"rouge-{n}").alias("metric"), *_scores(F.col("hits"), F.col("nr"), F.col("nh")))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two lists of tokens.

    A row of the table is one integer with a bit for each token of a, 0 where the length grows; a token of b moves all bits
    at once by an addition. No built-in function keeps such a state, and a fold over arrays copies a row at every cell.
    """

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_lcs(p, q) for p, q in zip(x, y)], dtype="int64")

    return run(a, b)


def _lcs(a: Sequence[str], b: Sequence[str]) -> int:
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for t in b:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    rows = pairs.select(key, rouge_tokens(F.col("reference")).alias("a"), rouge_tokens(F.col("hypothesis")).alias("b")).withColumn("hits", lcs_length(F.col("a"), F.col("b")))
    return rows.select(key, F.lit("rouge-l").alias("metric"), *_scores(F.col("hits"), F.size("a"), F.size("b")))


def rouge(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    return rouge_n(pairs, 1, key).unionByName(rouge_n(pairs, 2, key)).unionByName(rouge_l(pairs, key))


def similarity(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, scores) of pairs of texts: all metrics as one map, for use as a similarity."""
    return nested(rouge(pairs, key), key)


def macro_average(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric").agg(*(F.avg(c).alias(c) for c in ("p", "r", "f")))


def nested(scores: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, scores): one map from metric to (f, p, r) per pair."""
    return scores.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("f", "p", "r"))))).alias("scores"))
