"""Linking, walks and expansion of keywords against direct computations with difflib."""

import difflib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.config import Expansion
from textloom.functions import similarity as S, text as T
from textloom.functions.vectors import hashed_vector, merge_pieces
from textloom.operators import expand, ontology, rouge, scoring
from textloom.plans import queries

NODES = {"N1": ["heart disease", "cardiac illness"], "N2": ["heart attack"], "N3": ["lung diseases", "lungs"], "N4": ["vessel"], "N5": ["aspirin", "acid"]}
EDGES = [("N1", "N2"), ("N4", "N1"), ("N4", "N3")]
ASKED = [(1, ["hearth attack", "lungs"], ["care", "heart"]), (2, ["nothing alike"], ["aid"]), (3, [], [])]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def slow_links(ners):
    out = {}
    for ner in ners:
        for node, terms in NODES.items():
            close = difflib.get_close_matches(ner, terms, n=1, cutoff=0.6)
            if close:
                a, b = close[0].split(" "), ner.split(" ")
                hits = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if ratio(x, y) >= 0.8]
                w = (len({i for i, _ in hits}) + len({j for _, j in hits})) / (len(a) + len(b))
                if w >= 0.7:
                    out[ner, node] = (close[0], w)
    return out


def slow_walk(node, weight, decay=0.3):
    """Largest weight over all walks."""
    best, left = defaultdict(float), [(node, weight)]
    while left:
        at, w = left.pop()
        if w < 1 or w <= best[at]:
            continue
        best[at] = w
        for side in ([p for p, c in EDGES if c == at], [c for p, c in EDGES if p == at]):
            if side and (passed := (1 - decay) * (w / len(side))) > 1:
                left += [(x, passed) for x in side]
    return {k: v for k, v in best.items() if v}


def tables(spark):
    nodes = spark.createDataFrame([(k, v, ["C1"]) for k, v in NODES.items()], "node_id string, terms array<string>, tree_numbers array<string>")
    return ontology.Ontology(nodes, spark.createDataFrame(EDGES, "parent_id string, child_id string"))


def test_links(spark):
    ners = ["hearth attack", "hart attack", "lungs", "lung", "cardiac ilness", "x", "", "acid aspirin"]
    got = expand.link_entities(spark.createDataFrame([(n,) for n in ners], "ner string"), tables(spark).nodes).collect()
    assert {(r.ner, r.node_id): (r.term, pytest.approx(r.weight)) for r in got} == slow_links(ners)


def test_ratios_are_not_symmetric(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("abcd", "bcde"), ("", "a"), ("heart attack", "hearth attack")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.word_ratio()(F.col("a"), F.col("b")).alias("r"), S.close_ratio()(F.col("a"), F.col("b")).alias("c"))
    for r in rows.collect():
        assert r.r == pytest.approx(ratio(r.a, r.b)) and r.c == pytest.approx(ratio(r.a, r.b) if ratio(r.a, r.b) >= 0.6 else r.c)
    assert ratio("tide", "diet") != ratio("diet", "tide")


@pytest.mark.parametrize("weight", [1.0, 2.0, 3.0, 9.0])
def test_walk_of_any_weight(spark, weight):
    o = tables(spark)
    seeds = spark.createDataFrame([(n, n, weight) for n in NODES], "seed string, node_id string, weight double")
    got = {(r.seed, r.node_id): round(r.weight, 9) for r in expand.ontology_walk(seeds, o.nodes, o.edges).collect()}
    assert got == {(n, m): round(w, 9) for n in NODES for m, w in slow_walk(n, weight).items()}


def test_expanded_keywords(spark):
    """Order: entities, the ontology's terms, nouns, the lexicon's tokens; a keyword has its largest weight."""
    words, members, links = queries._lexicon(spark)
    tagged = spark.createDataFrame(ASKED, "question_id long, ners array<string>, nouns array<string>")
    rows, more = expand.expanded_keywords(spark, tagged, tables(spark), expand.Lexicon(words, members, links))
    strip = lambda t: " ".join(t.replace("diseases", "").replace("disease", "").split())
    reached = expand.synset_walk(spark, words.select(F.col("word").alias("seed"), F.col("synset").alias("node"), F.lit(4.0).alias("weight")), links)
    of_word = defaultdict(dict)
    for r in reached.join(members, reached.node == members.synset).collect():
        of_word[r.seed][r.token.lower()] = max(of_word[r.seed].get(r.token.lower(), 0), r.weight)
    got = defaultdict(list)
    for r in rows.orderBy("question_id", "kw_pos").collect():
        got[r.question_id].append((r.keyword, round(r.weight, 9)))
    extensions = {(r.question_id, r.token) for r in more.collect()}
    for q, ners, nouns in ASKED:
        terms, links_ = defaultdict(float), slow_links(ners)
        for (_, node), (_, w) in links_.items():
            for other, passed in slow_walk(node, 2 * w).items():
                for t in NODES[other]:
                    terms[strip(t)] = max(terms[strip(t)], passed)
        found = defaultdict(float)
        for n in nouns:
            for t, w in of_word[n].items():
                if t not in nouns and " " not in t:
                    found[t] = max(found[t], w)
        order = [*ners, *sorted(terms), *nouns, *sorted(found)]
        weights = defaultdict(float)
        for k, w in [*((n, 2.0) for n in ners), *terms.items(), *((n, 4.0) for n in nouns), *found.items()]:
            weights[k] = max(weights[k], w)
        assert got[q] == [(k, round(weights[k], 9)) for k in dict.fromkeys(order)]
        assert {t for i, t in extensions if i == q} == set(found)
    plain, none = expand.expanded_keywords(spark, tagged, config=Expansion(entity_weight=0))
    assert sorted(r.keyword for r in plain.collect()) == ["aid", "care", "heart"] and none.count() == 0


def test_word_mover_with_vectors_and_extensions(spark):
    """Against sums by hand: each asked word's largest cosine with a word of the sentence."""
    sentences = spark.createDataFrame([(1, 1, 1, ["warm", "milk"]), (1, 1, 2, ["cold"]), (1, 1, 3, [])], "question_id long, answer_id long, sentence_id int, tokens array<string>")
    tagged = spark.createDataFrame([(1, ["warm", "gone"])], "question_id long, nouns array<string>")
    keywords = spark.createDataFrame([(1, 0, "warm", 4.0), (1, 1, "cold", 2.0)], "question_id long, kw_pos int, keyword string, weight double")
    vocabulary = spark.createDataFrame([(1, "warm", 0.5), (1, "cold", 1.0), (1, "milk", 1.0)], "question_id long, term string, weight double")
    vectors = spark.createDataFrame([("warm", [1.0, 0.0]), ("cold", [0.6, 0.8]), ("milk", [0.0, 1.0])], "token string, vec array<double>")
    more = spark.createDataFrame([(1, "cold")], "question_id long, token string")
    got = {r.sentence_id: r.raw for r in scoring.word_mover(sentences, tagged, keywords, vocabulary, vectors, more).collect()}
    w = {"warm": 4 * 0.5, "cold": 2 * 1.0}
    assert got[1] == pytest.approx((w["warm"] * 1 + w["cold"] * 0.8) / 4) and got[2] == pytest.approx((w["warm"] * 0.6 + w["cold"]) / 4) and got[3] == 0
    alone = {r.sentence_id: r.raw for r in scoring.word_mover(sentences, tagged, keywords, vocabulary).collect()}
    assert alone == {1: 1.0, 2: 0.0, 3: 0.0}


def test_common_subsequences():
    import random

    rnd = random.Random(3)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not b else row
            new = [0]
            for j, y in enumerate(b):
                new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = (rnd.choices("abcd", k=rnd.randint(0, 12)) for _ in "ab")
        assert rouge._lcs(a, b) == slow(a, b)


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    numbers = F.array(*map(F.lit, (1.0, 4.0)))
    assert one(S.best_of(numbers)) == 4.0 and one(S.average(numbers)) == 2.5
    assert tuple(one(T.node_ref(F.lit("http://x/MONDO_0001")))) == ("MONDO", "0001")
    assert one(hashed_vector(F.array(F.lit("a"), F.lit("a")))) == [2 * x for x in one(hashed_vector(F.array(F.lit("a"))))]
    long = "##" + "y" * 3000
    merged = one(merge_pieces(F.array(*map(F.lit, ("x", long, "z"))), F.array(*[F.array(F.lit(float(k))) for k in (2, 4, 1)])))
    assert merged["w"] == ["x" + "y" * 3000, "z"] and merged["v"] == [[3.0], [1.0]]
    with pytest.raises(ValueError):
        scoring.score_column("other")
