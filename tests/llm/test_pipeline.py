"""The corpus pipeline, each stage held against brute force over what its predecessor kept."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.test_tables import slow_hits, slow_lines
from textloom.llm import quality
from textloom.llm.common import materialize, table

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    columns, before = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before[name] = docs.toPandas()
        docs = materialize(spark, stage(spark, docs, small_dir), name)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before["end"] = docs.toPandas()
    ids = {name: set(x.doc_id) for name, x in before.items()}

    model = quality.train(table(spark, small_dir, "documents"), table(spark, small_dir, "labels"))
    score = model.score(np.array([quality.statistics((t or "").encode()) for t in before["quality"].text], np.float32))
    assert ids["lines"] == set(before["quality"].doc_id[score >= 0.5])

    own = [(i, None if t is None else t) for i, t in zip(before["lines"].doc_id, before["lines"].text)]
    kept = {i: t for i, _, gone, t in slow_lines(own) if not gone or re.sub(r"\s+", "", t or "")}
    assert dict(zip(before["near_duplicates"].doc_id, before["near_duplicates"].text)) == kept
    assert all(before["near_duplicates"].n_chars == before["near_duplicates"].text.map(len))

    shingles = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set()
    rest = [shingles(t) for t in before["contamination"].text]
    alike = sum(len(a & b) >= 0.9 * len(a | b) for k, a in enumerate(rest) for b in rest[:k] if a and b)
    assert alike == 0 and ids["contamination"] <= ids["near_duplicates"]
    for i, t in zip(before["near_duplicates"].doc_id, before["near_duplicates"].text):
        if i not in ids["contamination"]:  # what went has a similar text that stayed
            assert max(len(shingles(t) & x) / max(1, len(shingles(t) | x)) for x in rest) > 0.5 or not shingles(t)

    items = [(r.item_id, r.text) for r in table(spark, small_dir, "benchmark").collect()]
    hits = slow_hits(list(zip(before["contamination"].doc_id, before["contamination"].text)), items)
    assert ids["mix"] == {i for i, _, _, n, *_ in hits if n == 0}

    assert ids["end"] <= ids["mix"]
    assert (before["end"].copies >= 1).all() and (before["end"].copies <= 3).all()


def test_stages_stand_odd_rows(spark, small_dir):
    """Rows of all kinds, with and without a column of every name used inside: the same ones stay, and no column is changed."""
    plain = cases.docs(spark).select(table(spark, small_dir, "documents").columns)
    named = cases.with_names(cases.docs(spark))
    for name, stage in pipeline.STAGES:
        rows = []
        for given in (plain, named):
            got = stage(spark, given, small_dir)
            assert got.columns[: len(given.columns)] == given.columns and (name == "mix" or got.columns == given.columns)
            assert [f.dataType for f in got.schema][: len(given.columns)] == [f.dataType for f in given.schema]
            assert stage(spark, given.limit(0), small_dir).count() == 0
            data = got.toPandas()
            for k, c in enumerate(cases.INSIDE if given is named else []):
                assert (data[c] == (k if k % 2 else f"v{k}")).all()
            rows.append(sorted(data[plain.columns].itertuples(index=False, name=None), key=repr))
        assert len(rows[0]) <= plain.count() and repr(rows[0]) == repr(rows[1])


def test_run(spark, small_dir):
    rows = pipeline.run(spark, small_dir)
    assert rows.count() > 50 and rows.select(F.min("words")).first()[0] > 0
