"""Every query that has SQL gives the same rows as DuckDB; the others hold simple properties."""

import pytest

from tests import parity
from textloom.plans import queries as plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small_dir, duck, name):
    parity.assert_same(QUERIES[name](spark, small_dir), duck, SQL[name])


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


def test_summaries(spark, small_dir):
    rows = QUERIES["full_summary"](spark, small_dir).collect()
    assert len(rows) == 16 and all(r.summary and "?" not in r.summary for r in rows if r.summary is not None)


def test_entry_works_without_the_optional_parts(spark, small_dir, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def union_find(pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_the_whole_table(spark, tmp_path):
    """Against union-find, with links of any quantity."""
    rows = [(i, 100 + i % 7, float(i % 50)) for i in range(30)] + [(40 + i, 200 + i, 1.0) for i in range(5)] + [(40, 201, 50.0), (60, 300, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = [(f"S{s}", f"P{p}") for s, p, _ in rows]
    got = {r.node: r.root for r in QUERIES["bipartite_components"](spark, str(tmp_path)).collect()}
    assert got == union_find(pairs)
