"""Exact duplicates, repeated lines, benchmark passages and mixing, against SQL and brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests import parity
from tests.llm import cases
from textloom.llm import decontaminate, exact_dedup, line_dedup, mixing, queries
from textloom.llm.common import table

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op6_line_dedup", "op7_decontaminate", "op8_mix_sources"])
def test_queries_against_sql(spark, small_dir, duck, name):
    parity.assert_same(queries.queries()[name](spark, small_dir), duck, SQL[name])


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def slow_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], sha(t)) for i, t in rows), key=repr)


@pytest.mark.parametrize("capacity,hot", [(1, 1), (3, 1000), (1 << 20, 2)])
def test_exact_duplicates(spark, capacity, hot):
    docs = cases.docs(spark)
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(spark, docs, capacity, 6, hot).collect()), key=repr)
    assert got == slow_exact([(r.doc_id, r.text) for r in docs.collect()])


def test_owners_follow_the_directory(spark, monkeypatch):
    """Rows whose bucket the directory doesn't have belong to nobody; all others are as before, and a bucket is in one file."""
    docs = cases.docs(spark, [(i, f"text {i % 200}", "en", "a") for i in range(600)])
    whole = exact_dedup.exact_duplicates(spark, docs, 20).collect()
    kept, lost = exact_dedup.directory, []

    def without(*a):
        buckets = kept(*a)
        lost.append(buckets.orderBy("prefix", "depth").first())
        return buckets.where((F.col("depth") != lost[0].depth) | (F.col("prefix") != lost[0].prefix))

    index, buckets = exact_dedup.build_index(spark, docs, 20)
    files = index.select("bucket", F.input_file_name().alias("f")).distinct().collect()
    assert buckets.count() >= 10 and len(files) == len({r.bucket for r in files}) == buckets.count()
    monkeypatch.setattr(exact_dedup, "directory", without)
    left = exact_dedup.exact_duplicates(spark, docs, 20).collect()
    assert 0 < len(left) < len(whole) and set(left) <= set(whole)


def test_equal_hashes_are_chained(spark, monkeypatch):
    """With a hash that many texts share, texts are still told apart by their bytes."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.length(c).cast("long"))
    docs = cases.docs(spark)
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(spark, docs, 2).collect()), key=repr)
    assert got == slow_exact([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(spark, cases.docs(spark, [])).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.xxhash64("id")).alias("h"))
    leaves = {(r.depth, r.prefix) for r in exact_dedup.directory(spark, keys, 200, 12).collect()}
    held = Counter()
    for (h,) in keys.collect():
        own = [(d, p) for d, p in leaves if (h & 2**64 - 1) >> 64 - d == p]
        assert len(own) == 1
        held[own[0]] += 1
    assert all(n <= 200 for (d, _), n in held.items() if d < 12) and max(d for d, _ in leaves) == 12


def slow_lines(rows):
    """Windows in order of id (nulls first), each distinct (id, text) one document."""
    seen, drop = set(), defaultdict(set)
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        l = [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
        for a in range(len(l) - 2):
            key = tuple(x for _, x in l[a : a + 3])
            if key in seen:
                drop[i, t] |= {k for k, _ in l[a : a + 3]}
            seen.add(key)
    cut = lambda i, t: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i, t])
    return sorted(((i, len((t or "").split("\n")) if t is not None else 0, len(drop[i, t]), None if t is None else cut(i, t)) for i, t in rows), key=repr)


def test_line_dedup_edges(spark):
    extra = [(20, "a\nb\nc\na\nb\nc\na\nb", "en", "a"), (21, "z\na\nb\nc\n", "en", "a"), (21, "z\na\nb\nc\n", "en", "a"), (22, " a\n\n b \nc\nq", "en", "a"), (23, "same\nsame\nsame\nsame\nsame", "en", "a"), (24, "\n\n\n", "en", "a")]
    docs = cases.docs(spark, cases.TEXTS + extra).withColumn("n_lines", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark, docs).collect()), key=repr)
    assert got == slow_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert line_dedup.dedup_lines(spark, docs.limit(0)).count() == 0


def test_other_columns_are_passed_on(spark):
    named = cases.with_names(cases.docs(spark))
    got = line_dedup.dedup_lines(spark, named)
    assert sorted(got.columns) == sorted(named.columns)
    left = got.toPandas()
    assert all((left[c] == (k if k % 2 else f"v{k}")).all() for k, c in enumerate(cases.INSIDE) if c not in ("n_lines", "n_removed"))
    for rows in (exact_dedup.exact_duplicates(spark, named), mixing.mix(spark, named), decontaminate.contamination(spark, named, named.select(F.col("doc_id").alias("item_id"), "text", "terms" if "terms" in named.columns else "w"))):
        assert rows.count() == len(cases.TEXTS)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow_hits(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, b in items:
            b = words(b)
            for s in range(max(1, len(b) - 7) if b else 0):
                own = b[s : s + 8]
                for at in range(len(w) - len(own) + 1):
                    if w[at : at + len(own)] == own:
                        hit |= set(range(at, at + len(own)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2))
    return sorted(out, key=repr)


ITEMS = [(1, cases.SAID), (2, "gamma Delta"), (10, "ZETA eta theta iota kappa lambda mu nu xi"), (3, None), (4, " .,"), (5, "a a a a a a a a a"), (6, "É"), (7, "missing words only"), (8, "eta"), (8, "Eta")]


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, terms string")
    docs = cases.docs(spark)
    want = slow_hits([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert sorted((tuple(r) for r in decontaminate.contamination(spark, docs, items).collect()), key=repr) == want
    assert decontaminate.contamination(spark, docs.limit(0), items).count() == 0
    none = decontaminate.contamination(spark, docs, items.limit(0)).collect()
    assert len(none) == len(cases.TEXTS) and all(r.n_items == 0 and r.n_hit == 0 and r.items_sha256 == sha("") for r in none)


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 1)
    test_decontamination_edges(spark)


def slow_places(w, terms, slop, counts):
    """Starts by the anchor (the rarest term, then the first): every choice of distinct places within slop is tried."""
    import itertools

    anchor = min(range(len(terms)), key=lambda k: (counts[terms[k]], k))
    out = set()
    for p, x in enumerate(w):
        if x != terms[anchor]:
            continue
        start = p - anchor
        reach = [[p] if k == anchor else [q for q in range(start + k - slop, start + k + slop + 1) if 0 <= q < len(w) and w[q] == t] for k, t in enumerate(terms)]
        if any(len(set(c)) == len(c) for c in itertools.product(*reach)):
            out.add(start)
    return out


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity(spark, slop):
    """Each term in reach of its own place, repeats by places of their own; against every choice of places."""
    import random

    rnd = random.Random(slop)
    texts = ["one two three four", "one x two three four", "four x x x x x x one two three", "a a b", "a b a", "a x b", "a b"] + [" ".join(rnd.choices("abcx", k=9)) for _ in range(40)]
    items = {1: "one two three four", 2: "a a b", 3: "a b", 4: "c", 5: "b a c a"}
    docs = cases.docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    counts = Counter(x for t in texts for x in t.split())
    got = {(r.id, i, r.start) for r in decontaminate.phrase_matches(spark, docs, spark.createDataFrame(list(items.items()), "item_id long, text string"), slop=slop).where("start IS NOT NULL").collect() for i in r["items"]}
    want = {(i, str(k), max(0, s)) for i, t in enumerate(texts) for k, terms in items.items() for s in slow_places(t.split(), terms.split(), slop, counts)}
    assert got == want


def test_matches_come_from_the_postings(spark, monkeypatch):
    """Without the postings of one term, no window that has it is found."""
    docs, items = cases.docs(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.post

    def without(*a, **k):
        terms, postings = kept(*a, **k)
        return terms, postings.join(terms.where("word = 'gamma'"), "term", "left_anti")

    monkeypatch.setattr(decontaminate, "post", without)
    want = slow_hits([(r.doc_id, r.text) for r in docs.collect()], [x for x in ITEMS if "gamma" not in words(x[1])])
    got = sorted((tuple(r) for r in decontaminate.contamination(spark, docs, items).collect()), key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[3] for r in got if r[0] == 12] == [r[3] + 1 for r in want if r[0] == 12]


def test_no_text_is_shuffled(spark, small_dir):
    """The plan that writes the postings has no exchange on the documents' side, and later plans read postings only."""
    docs, items = table(spark, small_dir, "documents"), table(spark, small_dir, "benchmark")
    windows, _ = decontaminate.test_windows(spark, items)
    terms, postings = decontaminate.post(spark, docs, windows)
    assert {f.name for f in postings.schema} == {"row", "id", "term", "pos"} and all("benchmark" not in f and "documents" not in f for f in postings.inputFiles())


def test_mixing_meets_its_targets(spark):
    for sf in ("/root/testdata/sf0.01",):
        docs = table(spark, sf, "documents")
        rows = mixing.mix(spark, docs).join(docs.select("doc_id", "source"), "doc_id").collect()
        again = {r.doc_id: r.taken for r in mixing.mix(spark, docs.repartition(7)).collect()}
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
            assert again[r.doc_id] == r.taken <= 3 * r.size
        whole = sum(r.size for r in rows)
        assert abs(sum(own[0].target for own in by.values()) - min(whole, 3 * whole)) < 1e-6 * whole
        for own in by.values():
            assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 1


def test_mixing_of_rows_without_id(spark):
    """Rows without id have places of their own, so a part of them can be taken."""
    docs = cases.docs(spark, [(i if i % 3 else None, f"w{i} " * (1 + i % 5), "en", "abc"[i % 2]) for i in range(1200)])
    rows = mixing.mix(spark, docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r.taken)
    assert len(by) == 2 and all(abs(sum(own) - target) <= 0.01 * target for (_, target), own in by.items())


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing_edges(spark):
    docs = cases.docs(spark)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    want = slow_targets(sizes)
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(cases.TEXTS)
    left = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got)
    assert left == Counter((i, size(t), sizes[s], round(want[s], 6)) for i, t, _, s in cases.TEXTS)
    assert all(r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(spark, docs.limit(0)).count() == 0
    empty = mixing.mix(spark, cases.docs(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert [r.taken for r in empty] == [0, 0]


def test_targets_by_sharing_again_and_again(spark):
    import random

    rnd = random.Random(5)
    for n in (1, 2, 7, 20):
        sizes = {f"s{k:02}": rnd.choice([1, 3, 10, 1000, 50000]) for k in range(n)} | ({None: 17} if n > 2 else {})
        rows = spark.createDataFrame([(str(s), s, v) for s, v in sizes.items()], "k string, source string, source_size long")
        got = {r.source: r.target for r in mixing.target_sizes(rows).collect()}
        want = slow_targets(sizes)
        assert all(abs(got[s] - want[s]) <= 1e-6 * want[s] for s in sizes)
