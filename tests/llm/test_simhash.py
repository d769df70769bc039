from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from textloom.llm import simhash
from textloom.llm.common import connected_components, table


def slow_fingerprint(text, shingle=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    own = [" ".join(w)] if len(w) < shingle else [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """All pairs; ids of equal fingerprints together, nulls ignored as the smallest."""
    ids = defaultdict(list)
    for i, f in rows:
        ids[f].append(i)
    fps = sorted(ids)
    root = cases.union_find([(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2], fps)
    least = defaultdict(list)
    for f in fps:
        least[root[f]] += [i for i in ids[f] if i is not None]
    return sorted(((i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in rows), key=repr)


def check(spark, docs):
    texts = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(spark, docs).collect()), key=repr)
    assert got == slow_components(texts)


def test_whole_table_against_all_pairs(spark, small_dir):
    check(spark, table(spark, small_dir, "documents"))


def test_edges_and_empty(spark):
    check(spark, cases.docs(spark))
    check(spark, cases.docs(spark, []))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBéİ \t\n  ", max_size=60))
def test_fingerprint(text):
    f = simhash.fingerprint(text.encode(), 3)[0]
    assert int(f) & (2**64 - 1) == slow_fingerprint(text)


def test_blocks_of_long_texts(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500)).encode()
    whole = simhash.fingerprint(text, 3, 4).tolist()
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text, 3, 4).tolist() == whole


def test_ball_links_find_all_pairs_within_two_bits(spark):
    import random

    rnd = random.Random(3)
    keys = {0, 1, 3, 7, 2**63, 2**64 - 1}
    for _ in range(60):
        x = rnd.getrandbits(64)
        keys |= {x, x ^ 1 << rnd.randrange(64), x ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64), x ^ 7 << rnd.randrange(60)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    links = simhash.ball_links(spark.createDataFrame([(signed(k),) for k in keys], "key long"))
    found = [(r.u & 2**64 - 1, r.v & 2**64 - 1) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    close = [(a, b) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 2]
    assert cases.union_find(found, keys) == cases.union_find(close, keys)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (300, 100)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 300: 100}
    assert connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    word = lambda i: f"w{i * 7919 % 1009}"
    base = [word(i) for i in range(300)]
    near = [*base[:150], "changed", *base[151:]]
    other = [word(i + 2000) + "x" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base)), (5, None), (6, ""), (7, " ".join(base[:100]))]
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, "row_id long, text string"))
    assert {r.row_id: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5, 7: 7}


def test_near_duplicates_find_similar_texts(spark, small_dir):
    """Of planted copies with a Jaccard similarity over 0.85, nearly all are found, and no unlike texts meet."""
    docs = table(spark, small_dir, "documents").where(F.size(F.split("text", " ")).between(80, 400)).dropDuplicates(["text"])
    rows = [(r.doc_id * 10, r.text) for r in docs.collect()]
    changed = []
    for i, t in rows:
        w = t.split()
        at = (i * 31) % (len(w) - 10) + 5
        changed.append((i + 1, " ".join([*w[:at], "swapped", *w[at + 1 :]])))
    got = {r.row_id: r.component for r in simhash.near_duplicates(spark, spark.createDataFrame(rows + changed, "row_id long, text string")).collect()}
    assert sum(got[i + 1] == got[i] for i, _ in rows) >= 0.97 * len(rows)


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_by_bands_of_similarity(spark):
    """Of planted pairs of each band at least 0.9 are linked, also within a family whose texts share most of their words; none below 0.8."""
    import random

    rnd = random.Random(11)
    for shared in (0, 150):
        rows, bands = [], defaultdict(list)
        for i in range(0, 9000, 10):
            w = [f"s{k}" for k in range(shared)] + [f"t{i}x{k}" for k in range(250 - shared)]
            changed = list(w)
            for part in range(rnd.choice([1, 2, 3])):
                at, n = rnd.randrange(shared, 240), rnd.randint(1, 14)
                changed[at : at + n] = [f"c{i}x{part}x{k}" for k in range(n)]
            pair = " ".join(w), " ".join(changed)
            rows += [(i, pair[0]), (i + 1, pair[1])]
            j = jaccard(*pair)
            bands[0.8 if j < 0.85 else 0.85 if j < 0.9 else 0.9].append(i) if j >= 0.8 else bands[0].append(i)
        got = {r.row_id: r.component for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, "row_id long, text string")).collect()}
        found = {b: sum(got[i] == got[i + 1] for i in own) / len(own) for b, own in bands.items()}
        assert all(len(own) > 60 for own in bands.values())
        assert found[0] == 0 and found[0.8] >= 0.9 and found[0.85] >= 0.97 and found[0.9] >= 0.99, found
        assert len(set(got.values())) == 2 * 900 - sum(round(found[b] * len(bands[b])) for b in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbBcé \t\n\x0b  ", max_size=40), max_size=6), st.sampled_from([8, 64, 1 << 16]))
def test_sets_of_shingles(texts, block):
    """As many distinct hashes as distinct runs of five words; the same ones whatever the block and the other texts."""
    import numpy as np

    texts = [t.encode() for t in texts] + [b"one two three four five six " * 40 + b"long" * 30]
    whole, kept = simhash.Shingler(5)(texts), simhash.TEXT
    try:
        simhash.TEXT = block
        other = [simhash.Shingler(5)([t])[0] for t in texts]
    finally:
        simhash.TEXT = kept
    for t, own, again in zip(texts, whole, other):
        w = t.lower().split()
        n = min(5, len(w))
        assert len(own) == len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
        assert block == 8 or max(map(len, w), default=0) >= block or np.array_equal(own, again)


@pytest.mark.parametrize("family", [0, 200, 291])
def test_group_links_in_blocks(spark, monkeypatch, family):
    """Groups over MEMBERS, dealt to blocks, have the components of all pairs, and a large family isn't multiplied."""
    import random

    rnd = random.Random(5)
    values = [1 << (i % 16) if i % 3 else 0 for i in range(family)]
    while len(values) < 300:
        values.append(values[-1] ^ 1 << rnd.randrange(16) if len(values) % 3 == 2 else rnd.getrandbits(16))
    rnd.shuffle(values)
    rows = spark.createDataFrame([(g, i, 1 + i % 2, [v]) for g in (1, 2) for i, v in enumerate(values) if g == 1 or i < 9], "group long, node long, weight long, fp array<long>")
    monkeypatch.setattr(simhash, "MEMBERS", 20)
    monkeypatch.setattr(simhash, "PIVOTS", 4)
    sizes, met = rows.groupBy("group").agg(F.sum("weight").alias("size")), []
    attach = lambda x: met.append(x.count()) or x
    found = [(r.u, r.v) for r in simhash.group_links(spark, rows, sizes, attach, "fp", simhash.within_bits(1), "test-links").collect()]
    close = [(a, b) for a in range(300) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 1]
    assert cases.union_find(found, range(300)) == cases.union_find(close, range(300))
    assert met[0] < 309 + 23 * 12  # a few members are in all of 23 blocks
    assert family < 291 or sum(met[1:]) <= 2 * 291 + 9 * 46  # its members twice, for two blocks of the others


def test_groups_of_one_label_are_left_out(spark):
    """Of values near a variant, those that all have one label don't meet; any other group stays whole."""
    import random

    rnd = random.Random(7)
    values = {}
    for _ in range(40):
        x, label = rnd.getrandbits(32), rnd.choice([0, 1, 2, 32767])
        for _ in range(5):
            values[(3 << 32) | x ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(32))] = label if rnd.random() < 0.8 else rnd.choice([0, 1, 2])
    near = defaultdict(set)
    for v in values:
        for x in (v, *(v ^ 1 << i for i in range(32))):
            near[x].add(v)
    want = {x: own for x, own in near.items() if len(own) > 1 and (len({values[v] for v in own}) > 1 or values[min(own)] == 0)}
    got = simhash.ball_groups(spark.createDataFrame(list(values.items()), "key long, label long"), 32).collect()
    assert {r.variant: set(r["all"]) for r in got} == want and len(want) < sum(len(own) > 1 for own in near.values())


@pytest.mark.parametrize("most", [0, 1, 1 << 14])
def test_a_joined_family_does_not_come_back(spark, monkeypatch, most):
    """Near copies that equal slices join aren't written again under the variants of their slices; without labels the result is the same."""
    import random

    rnd, base, rows = random.Random(2), [f"b{k}" for k in range(200)], []
    for i in range(300):
        w, at = list(base), rnd.randrange(200)
        w[at] = f"c{i}"
        rows += [(i, " ".join(w)), (1000 + i, " ".join(f"o{i}x{k}" for k in range(60)))]
    kept, written = simhash.materialize, defaultdict(int)

    def spy(spark, df, name, *a):
        out = kept(spark, df, name, *a)
        written[name] += out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", spy)
    monkeypatch.setattr(simhash, "LABELS", most)
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, "row_id long, text string"))
    assert {r.row_id: r.component for r in got.collect()} == {i: 0 if i < 1000 else i for i, _ in rows}
    assert most == 0 or written["slice-groups"] < 600


def test_near_duplicates_by_exact_similarity(spark):
    """A passage repeated within the text counts once; no pair under 0.8 is linked, whatever the bits say."""
    passage, own = [f"p{k}" for k in range(100)], lambda i: [f"o{i}x{k}" for k in range(500)]
    rows = [(i, " ".join([*passage * 8, *own(i)])) for i in range(3)] + [(i, " ".join(["a"] * 600 + own(i))) for i in range(3, 6)]
    for k in range(40):  # 50 words more in the middle: a similarity of 0.78 of the shingles (196 of 250)
        w = [f"m{k}x{j}" for j in range(200)]
        rows += [(100 + 2 * k, " ".join(w)), (101 + 2 * k, " ".join([*w[:100], *(f"n{k}x{j}" for j in range(50)), *w[100:]]))]
    rows += [(200, " ".join(own(200))), (201, " ".join(own(200)[:-30]))]  # 0.94
    got = {r.row_id: r.component for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, "row_id long, text string")).collect()}
    assert {i: c for i, c in got.items() if c != i} == {201: 200}


def test_within_jaccard():
    import random

    import numpy as np
    import pyarrow as pa

    rnd = random.Random(9)
    sets = [set(rnd.sample(range(12), rnd.randint(0, 12))) for _ in range(60)]
    near = simhash.within_jaccard(0.8)(pa.array([sorted(x) for x in sets], pa.list_(pa.int64())).slice(10, 50))
    sets = sets[10:]
    others = np.array([j for j in range(50) if j % 7])
    for i, a in enumerate(sets):
        assert near(i, others).tolist() == [5 * len(a & sets[j]) >= 4 * len(a | sets[j]) for j in others]
