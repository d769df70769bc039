"""Greedy de-duplication over several blocks, against a loop."""

import random

import pytest

from textloom.operators import mmr


def slow(vectors, duplicate):
    kept = []
    for i, v in vectors:
        near = lambda w: v is not None and w is not None and len(v) == len(w) and None not in v and None not in w and round(sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in w) ** 0.5 or 1), 12) >= duplicate
        if not any(near(w) for _, w in kept):
            kept.append((i, v))
    return [i for i, _ in kept]


@pytest.mark.parametrize("block", [7, 4096])
def test_blocks_give_what_one_loop_gives(spark, monkeypatch, block):
    """Groups of many blocks, a null group, zero, null and shorter vectors, and copies across blocks; 0.8 is met exactly."""
    monkeypatch.setattr(mmr, "BLOCK", block)
    rng = random.Random(5)
    groups = {g: [(100 * n + i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(size)] for n, (g, size) in enumerate({"a": 60, "b": 9, "c": 1, None: 20}.items())}
    groups["a"] += [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, 2.0]), (93, [2.0, 4.0]), (94, [0.0, 0.0, 0.0])]
    rows = [(g, i, i, v) for g, vs in groups.items() for i, v in vs]
    frame = spark.createDataFrame(rows[::-1], "label string, vec_id long, pos long, vec array<double>")
    for duplicate in (0.9, 0.8):
        got = sorted((str(r.label), r.vec_id) for r in mmr.greedy_dedupe(frame, duplicate, "label", "vec_id").collect())
        assert got == sorted((str(g), i) for g, vs in groups.items() for i in slow(vs, duplicate))


def test_nothing_in_nothing_out(spark):
    frame = spark.createDataFrame([], "label string, vec_id long, pos long, vec array<double>")
    assert mmr.greedy_dedupe(frame, group="label", item="vec_id").collect() == []
