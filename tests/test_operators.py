"""Small literal cases with values worked out by hand."""

import difflib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textloom.config import Diversity, LexRank
from textloom.functions import similarity, text as T
from textloom.operators import features, graph, mmr, rouge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,cleaned",
    [("a - Big", "a. Big"), ("in 2005 and 10", "in 2  and 10"), ("line\nbreak", "linebreak"), ("see [3] <b>x</b>", "see   x "), ("naïve", "na ve"), (None, None)],
)
def test_cleaning(spark, raw, cleaned):
    assert one(spark, T.clean_html(F.lit(raw).cast("string"))) == cleaned


@pytest.mark.parametrize(
    "segments,kept",
    [(["Is it?", "yes it is.", "Done."], ["yes it is.", "Done."]), (["Is it?", "Yes.", "Done."], ["Is it?", "Yes.", "Done."]), (["Is it? ", "yes."], ["Is it? ", "yes."]), (["Last?"], ["Last?"]), ([], [])],
)
def test_dangling_questions(spark, segments, kept):
    rows = spark.createDataFrame([(segments,)], "s array<string>")
    assert rows.select(T.drop_dangling(F.col("s")).alias("x")).first().x == kept


@pytest.mark.parametrize("values,scaled", [([2.0, 4.0], [0.0, 1.0]), ([5.0], [1.0]), ([0.0], [1.0]), ([-1.0], [0.0]), ([-1.0, -3.0], [2 / 3, 0.0]), ([3.0, 3.0], [1.0, 1.0])])
def test_minmax(spark, values, scaled):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    got = rows.withColumn("x", features.minmax(F.col("v"), ["g"])).orderBy("i").collect()
    assert [r.x for r in got] == pytest.approx(scaled)


def test_components_of_many_shapes(spark):
    edges = [(i, i + 1) for i in range(33)] + [(50, 60), (60, 70), (50, 70)]
    got = {r.node: r.root for r in graph.connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(34)} | {50: 50, 60: 50, 70: 50}


def test_walk_stops_below_the_least_weight(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)]
    got = graph.decayed_walk(spark, spark.createDataFrame([(1, 1, 4.0)], "seed long, node long, weight double"), spark.createDataFrame(edges, "a long, b long"), 0.2)
    assert {r.node: round(r.weight, 6) for r in got.collect()} == {1: 4.0, 2: 3.2, 3: 1.28}


def test_lexrank_threshold_is_checked():
    with pytest.raises(ValueError):
        LexRank(threshold=1)


def slow_mmr(items, query, lam, n, duplicate):
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5) for x in v]
    dot = lambda a, b: round(sum(x * y for x, y in zip(unit(a), unit(b))), 12)
    if len(items) < n:
        return [i for i, _, _ in items]
    left, picked = list(items), []
    while left and len(picked) < n:
        def score(x):
            own = lam * dot(x[2], query)
            most = max((dot(x[2], p[2]) for p in picked), default=None)
            return round(own if most is None else 0.0 if most >= duplicate else own - (1 - lam) * most, 9)

        best = max(left, key=score)
        left.remove(best)
        if all(p[1] != best[1] for p in picked):
            picked.append(best)
    return [i for i, _, _ in picked]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.tuples(*[st.integers(-3, 3)] * 3).filter(any)), min_size=1, max_size=9))
def test_mmr(spark, rows):
    items = [(i, t, list(map(float, v))) for i, (t, v) in enumerate(rows)]
    query = [1.0, 2.0, -1.0]
    frame = spark.createDataFrame([(7, i, i, t, v, query) for i, t, v in items], "question_id long, item long, pos long, text string, vec array<double>, query_vec array<double>")
    got = [r.item for r in mmr.mmr(frame, Diversity(0.85, 4, 0.9)).orderBy("step").collect()]
    assert got == slow_mmr(items, query, 0.85, 4, 0.9)


def test_rouge_tokens(spark):
    assert one(spark, rouge.rouge_tokens(F.lit("The Cat-sat, 2x!  é"))) == ["the", "cat", "sat", "2x"]
