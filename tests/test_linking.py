"""Ratios of entities and terms: the bound by characters rules out most pairs and no match."""

import difflib
import random

import pandas as pd

from textloom.functions import similarity
from textloom.operators import expand


def pairs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é漢\ud800𝒳") for _ in range(rng.randint(1, 14)))
    first = [word() for _ in range(1500)]
    return first + ["brazil", "", "aab", None], [w[1:] + w[:1] if i % 5 == 0 else w[:-1] + "q" if i % 7 == 0 else word() for i, w in enumerate(first)] + ["brasil", "", "baa", "x"]


def test_only_pairs_that_can_reach_the_ratio_are_matched(spark, monkeypatch):
    a, b = pairs()
    want = [None if x is None else (r if (r := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.6 else 0.0) for x, y in zip(a, b)]
    made, kept = [], difflib.SequenceMatcher
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda *x: made.append(x) or kept(*x))
    got = similarity.close_ratio().func(pd.Series(a), pd.Series(b)).tolist()
    assert [None if g != g else g if g >= 0.6 else 0.0 for g in got] == want
    assert len(made) < len(a) * 0.6


def test_links_of_terms_that_several_nodes_share(spark):
    nodes = spark.createDataFrame([("N1", ["brazil", "brasilia"]), ("N2", ["brazil"]), ("N3", ["peru", "peru"])], "node_id string, terms array<string>")
    got = expand.link_entities(spark.createDataFrame([("brazil",), ("brazik",), ("brazil",), ("para",)], "ner string"), nodes)
    assert sorted((r.ner, r.node_id, r.term) for r in got.collect()) == [(n, i, "brazil") for n in ("brazik", "brazil") for i in ("N1", "N2")]
