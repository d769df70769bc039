"""Queries of the summarisation operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import Expansion, LexRank, Selection
from ..functions import similarity as S, text as T
from ..operators import corpus, expand, features, graph, lexrank, mmr, ontology, rouge, scoring, select
from ..operators.storage import materialize
from ..sources import readers
from . import fixtures as X
from .oracle import K, STOP, clean, minmax, normal, query
from .summarize import prepared, score_sentences, summarize

KEY = corpus.KEY
Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _rs(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(corpus.answers(_t(spark, sf_dir, "conversations")))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences as a written table, for queries that read them more than once."""
    return materialize(spark, _sentences(spark, sf_dir), "sentences")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.question_tokens(corpus.questions(_t(spark, sf_dir, "conversations")))


# text


@_register(f"SELECT page_id, {clean('html')} AS cleaned FROM pages")
def clean_html_pages(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("cleaned"))


@_register(f"SELECT doc_id, {normal('text')} AS normalized FROM documents")
def normalize_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@_register(query("SELECT question_id, answer_id, i AS segment_id, l[i] AS segment FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM seg)", "seg"))
def segment_sentences(spark, sf_dir):
    rows = corpus.answers(_t(spark, sf_dir, "conversations")).withColumn("l", T.segments(T.clean_html(F.col("article"))))
    return rows.select("question_id", "answer_id", F.posexplode("l").alias("segment_id", "segment")).withColumn("segment_id", (F.col("segment_id") + 1).cast("long"))


@_register(query("SELECT question_id, answer_id, sentence_id, sentence FROM sent", "sent"))
def drop_dangling_questions(spark, sf_dir):
    return _sentences(spark, sf_dir).select(*KEY, "sentence")


@_register(query(f"SELECT {K}, array_to_string(tokens, ' ') AS tokens, array_to_string(ners, '|') AS ners FROM s", "s"))
def tokenize_filter_stopwords(spark, sf_dir):
    return _sentences(spark, sf_dir).select(*KEY, F.array_join("tokens", " ").alias("tokens"), F.array_join("ners", "|").alias("ners"))


@_register("SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[0-9A-Za-z_]+'), ' ') AS words FROM conversations")
def regex_words(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.word_tokens(F.col("text")), " ").alias("words"))


@_register("SELECT conv_id, turn, conv_id * 100000000 + turn * 10000 + 1 AS position, CAST(regexp_replace(conv_id || '_Answer' || turn, '[^0-9]', '', 'g') AS BIGINT) AS id_key FROM conversations")
def position_keys(spark, sf_dir):
    ident = F.concat(F.col("conv_id").cast("string"), F.lit("_Answer"), F.col("turn").cast("string"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", corpus.sort_position(F.col("conv_id"), F.col("turn"), F.lit(1)).alias("position"), T.position_key(ident).alias("id_key"))


@_register(query("SELECT question_id, keyword, kw_pos, weight FROM kw", "kw"))
def question_keywords(spark, sf_dir):
    return corpus.keywords(_tagged(spark, sf_dir)).withColumn("kw_pos", F.col("kw_pos").cast("int"))


@_register("SELECT page_id, regexp_replace(html, '\\[.*?\\]', '', 'g') AS stripped, regexp_matches(html, 'http\\S+|www.\\S+') AS has_url FROM pages")
def url_and_bracket_filters(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.strip_brackets(F.col("html")).alias("stripped"), T.has_url(F.col("html")).alias("has_url"))


@_register("SELECT p_partkey, trim(regexp_replace(replace(p_name || ' disease x', 'disease', ''), '\\s+', ' ', 'g')) AS stripped, split_part('http://x/' || replace(p_brand, '#', '_') , '/', 4) AS last_part FROM part")
def affix_and_iri(spark, sf_dir):
    iri = F.concat(F.lit("http://x/"), F.replace("p_brand", F.lit("#"), F.lit("_")))
    return _t(spark, sf_dir, "part").select("p_partkey", T.strip_disease(F.concat("p_name", F.lit(" disease x"))).alias("stripped"), T.last_segment(iri).alias("last_part"))


# features


@_register(query(f"SELECT {K}, term, tf FROM tf", "tf"))
def term_tf(spark, sf_dir):
    return corpus.term_counts(_sentences(spark, sf_dir))


@_register(query("SELECT question_id, term, df, n, round(idf, 6) AS idf FROM idf", "idf"))
def idf_smoothed(spark, sf_dir):
    rows = _written(spark, sf_dir)
    return features.smoothed_idf(corpus.term_counts(rows), features.question_sizes(rows), ["question_id"]).select("question_id", "term", "df", "n", *_r("idf"))


@_register(query("SELECT term, df, n, round(idf, 6) AS idf FROM ridf", "ridf"))
def idf_lexrank(spark, sf_dir):
    rows = _written(spark, sf_dir).withColumn("rank_tokens", T.rank_tokens(F.col("normalized")))
    return features.rank_idf(rows).select("term", "df", "n", *_r("idf"))


@_register(query("SELECT question_id, term, round(weight, 6) AS weight FROM vocab2", "vocab2"))
def inverse_idf_vocab(spark, sf_dir):
    return features.inverse_idf(_written(spark, sf_dir), _tagged(spark, sf_dir)).select("question_id", "term", *_r("weight"))


@_register(query(f"SELECT {K}, term, round(tfidf, 6) AS tfidf FROM tfidf", "tfidf"))
def tfidf_matrix_l2(spark, sf_dir):
    return features.tfidf(_written(spark, sf_dir)).select(*KEY, "term", *_r("tfidf"))


@_register(query("SELECT question_id, term, round(value, 6) AS value FROM fmax", "fmax"))
def tfidf_feature_max(spark, sf_dir):
    return features.feature_max(features.tfidf(_written(spark, sf_dir))).select("question_id", "term", *_r("value"))


@_register(query("SELECT question_id, round(threshold, 6) AS threshold FROM cut", "cut"))
def tfidf_rank_threshold(spark, sf_dir):
    return features.rank_threshold(features.feature_max(features.tfidf(_written(spark, sf_dir)))).select("question_id", *_r("threshold"))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM tfidf_none", "tfidf_none"))
def tfidf_score(spark, sf_dir):
    return features.tfidf_scores(_written(spark, sf_dir), mode="none").select(*KEY, *_r("raw", "score"))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM tfidf_weight", "tfidf_weight"))
def tfidf_score_weighted(spark, sf_dir):
    rows, tagged, keys = prepared(spark, _t(spark, sf_dir, "conversations"))
    return features.tfidf_scores(rows, keys, tagged, mode="weight").select(*KEY, *_r("raw", "score"))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM tfidf_ner", "tfidf_ner"))
def tfidf_score_ner(spark, sf_dir):
    return features.tfidf_scores(_written(spark, sf_dir), None, _tagged(spark, sf_dir), mode="ner").select(*KEY, *_r("raw", "score"))


# graph ranking

_NODE = lambda c: F.col(f"{c}.answer_id") * 100000 + F.col(f"{c}.sentence_id")


@_register(query("SELECT question_id, a, b, round(sim, 6) AS sim FROM sim", "sim"))
def idf_modified_cosine(spark, sf_dir):
    return lexrank.similarities(lexrank.weighted_terms(_written(spark, sf_dir))).select("question_id", _NODE("a").alias("a"), _NODE("b").alias("b"), *_r("sim"))


@_register(query("SELECT question_id, a, b, round(sim, 6) AS sim FROM ksim", "ksim"))
def keyword_weighted_cosine(spark, sf_dir):
    rows, _, keys = prepared(spark, _t(spark, sf_dir, "conversations"))
    boost = keys.select("question_id", F.col("keyword").alias("term"), "weight")
    return lexrank.similarities(lexrank.keyword_terms(rows), boost).select("question_id", _NODE("a").alias("a"), _NODE("b").alias("b"), *_r("sim"))


@_register(query(f"SELECT {K}, component FROM comp_thr", "comp_thr"))
def similarity_components(spark, sf_dir):
    rows, _, _ = prepared(spark, _t(spark, sf_dir, "conversations"))
    return lexrank.lexrank(spark, rows).select(*KEY, (F.col("component.answer_id") * 100000 + F.col("component.sentence_id")).alias("component"))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM lex_thr", "lex_thr"))
def lexrank_threshold(spark, sf_dir):
    rows, _, _ = prepared(spark, _t(spark, sf_dir, "conversations"))
    return lexrank.lexrank(spark, rows).select(*KEY, *_r("raw", "score"))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM lex_sim", "lex_sim"))
def lexrank_weighted(spark, sf_dir):
    rows, _, _ = prepared(spark, _t(spark, sf_dir, "conversations"))
    return lexrank.lexrank(spark, rows, LexRank(threshold=None)).select(*KEY, *_r("raw", "score"))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM lex_kw", "lex_kw"))
def lexrank_keyword(spark, sf_dir):
    rows, _, keys = prepared(spark, _t(spark, sf_dir, "conversations"))
    return lexrank.keyword_lexrank(spark, rows, keys).select(*KEY, *_r("raw", "score"))


# scorers


@_register(query("SELECT question_id, item, keyword, round(dice, 6) AS dice FROM dicepairs", "dicepairs"))
def keyword_dice(spark, sf_dir):
    rows, _, keys = prepared(spark, _t(spark, sf_dir, "conversations"))
    items = rows.select("question_id", F.explode(F.concat("ners", "tokens")).alias("item")).distinct()
    words = lambda df, c: df.select("question_id", c, F.explode(F.array_distinct(F.split(c, " "))).alias("word"))
    pairs = words(items, "item").join(words(keys, "keyword"), ["question_id", "word"]).select("question_id", "item", "keyword").distinct()
    return pairs.withColumn("dice", F.round(S.keyword_dice(F.col("item"), F.col("keyword")), 6))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM keyword", "keyword"))
def keyword_ratio(spark, sf_dir):
    rows, _, keys = prepared(spark, _t(spark, sf_dir, "conversations"))
    return scoring.keyword_ratio(rows, keys).select(*KEY, *_r("raw", "score"))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM moved", "moved"))
def word_mover_relaxed(spark, sf_dir):
    rows, tagged, keys = prepared(spark, _t(spark, sf_dir, "conversations"))
    return scoring.word_mover(rows, tagged, keys, features.inverse_idf(rows)).select(*KEY, *_r("raw", "score"))


@_register(query(f"SELECT {K}, round(raw, 6) AS raw FROM o_max", "o_max"))
def weighted_overlap_max(spark, sf_dir):
    rows, tagged, _ = prepared(spark, _t(spark, sf_dir, "conversations"))
    return scoring.weighted_overlap(rows, tagged, features.inverse_idf(rows, tagged)).select(*KEY, *_r("raw"))


@_register(query(f"SELECT {K}, round(raw, 6) AS raw FROM o_mean", "o_mean"))
def weighted_overlap_mean(spark, sf_dir):
    rows, tagged, _ = prepared(spark, _t(spark, sf_dir, "conversations"))
    return scoring.weighted_overlap(rows, tagged, features.inverse_idf(rows, tagged), "mean").select(*KEY, *_r("raw"))


@_register(query(f"SELECT {K}, {_rs('raw', 'score')} FROM query", "query"))
def query_similarity(spark, sf_dir):
    rows, tagged, _ = prepared(spark, _t(spark, sf_dir, "conversations"))
    return scoring.query_score(scoring.weighted_overlap(rows, tagged, features.inverse_idf(rows, tagged))).select(*KEY, *_r("raw", "score"))


def _candidates(spark, sf_dir) -> DataFrame:
    """Vectors of a label as candidates for the label's vector of the smallest id."""
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    first = vectors.groupBy("label").agg(F.min(F.struct("vec_id", "vec")).alias("q")).select("label", F.col("q.vec_id").alias("query_id"), F.col("q.vec").alias("query_vec"))
    return vectors.join(first, "label").where("vec_id <> query_id")


@_register(query("SELECT label, vec_id, round(q, 6) AS cosine FROM cand", "cand"))
def embedding_cosine(spark, sf_dir):
    return _candidates(spark, sf_dir).select("label", "vec_id", F.round(S.cosine(F.col("vec"), F.col("query_vec"), -1.0), 6).alias("cosine"))


@_register(query("SELECT label, vec_id, round(list_distance(v, qv), 6) AS distance FROM cand", "cand"))
def embedding_euclidean(spark, sf_dir):
    return _candidates(spark, sf_dir).select("label", "vec_id", F.round(S.euclidean(F.col("vec"), F.col("query_vec")), 6).alias("distance"))


@_register(query(f"SELECT label, vec_id, round({minmax('q', 'label')}, 6) AS score FROM cand", "cand"))
def embedding_query_score(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select("label", "vec_id", S.cosine(F.col("vec"), F.col("query_vec")).alias("q"))
    return rows.select("label", "vec_id", F.round(features.minmax(F.round("q", 12), ["label"]), 6).alias("score"))


@_register(f"SELECT event_id, round({minmax('value', 'user_id, event_type')}, 6) AS score FROM events")
def minmax_per_answer(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.round(features.minmax(F.col("value"), ["user_id", "event_type"]), 6).alias("score"))


@_register(f"SELECT event_id, round({minmax('value', 'user_id')}, 6) AS score FROM events")
def minmax_per_question(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.round(features.minmax(F.col("value"), ["user_id"]), 6).alias("score"))


@_register(query(f"SELECT {K}, {_rs('tfidf', 'lexrank', 'keyword', 'mover', 'query', 'final')} FROM final", "final"))
def score_fusion(spark, sf_dir):
    rows, tagged, keys = prepared(spark, _t(spark, sf_dir, "conversations"))
    return score_sentences(spark, rows, tagged, keys).select(*KEY, *_r("tfidf", "lexrank", "keyword", "mover", "query", "final"))


# selection


def _top(spark, sf_dir, config: Selection) -> DataFrame:
    rows, _, _ = prepared(spark, _t(spark, sf_dir, "conversations"))
    return select.top_sentences(rows.join(features.tfidf_scores(rows, mode="none"), KEY), config)


@_register(query(f"SELECT {K}, rank, chosen FROM top_num", "top_num"))
def topk_num(spark, sf_dir):
    return _top(spark, sf_dir, Selection(limit=5, kind="num")).select(*KEY, F.col("rank").cast("long").alias("rank"), "chosen")


@_register(query(f"SELECT {K}, rank, chosen FROM top_ratio", "top_ratio"))
def topk_ratio(spark, sf_dir):
    return _top(spark, sf_dir, Selection(limit=0.3, kind="ratio")).select(*KEY, F.col("rank").cast("long").alias("rank"), "chosen")


@_register(query(f"SELECT {K}, rank, chosen FROM top_threshold", "top_threshold"))
def topk_threshold(spark, sf_dir):
    return _top(spark, sf_dir, Selection(limit=0.5, kind="threshold")).select(*KEY, F.col("rank").cast("long").alias("rank"), "chosen")


@_register(query(f"SELECT {K} FROM filled", "filled"))
def gap_fill(spark, sf_dir):
    return select.fill_gaps(_top(spark, sf_dir, Selection())).select(*KEY)


@_register(query(f"SELECT {K}, merged_id FROM merged", "merged"))
def merge_answers(spark, sf_dir):
    return corpus.merged(select.fill_gaps(_top(spark, sf_dir, Selection()))).select(*KEY, "merged_id")


@_register(query("SELECT question_id, string_agg(sentence, ' ' ORDER BY answer_pos, sentence_id) AS article FROM s GROUP BY question_id", "s"))
def merged_articles(spark, sf_dir):
    return corpus.merged_article(_sentences(spark, sf_dir))


@_register(query(f"SELECT {K}, question_id * 100000000 + answer_id * 10000 + sentence_id AS position, row_number() OVER (PARTITION BY question_id ORDER BY answer_id, sentence_id) AS place FROM filled", "filled"))
def position_order(spark, sf_dir):
    rows = select.fill_gaps(_top(spark, sf_dir, Selection())).withColumn("position", corpus.sort_position(*map(F.col, KEY)))
    return rows.select(*KEY, "position", F.row_number().over(W.partitionBy("question_id").orderBy("answer_id", "sentence_id")).cast("long").alias("place"))


@_register(
    query(
        """SELECT label, CAST(i AS INTEGER) AS step, picked[i] AS vec_id FROM (SELECT label, picked, unnest(range(1, len(picked) + 1)) AS i FROM
  (SELECT label, arg_max(picked, step) AS picked, max(step) AS n FROM picks GROUP BY label) WHERE n = 25)
UNION ALL SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER), vec_id FROM cand WHERE label NOT IN (SELECT label FROM picks WHERE step = 25)""",
        "picks",
    )
)
def mmr_select(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select("label", "vec_id", F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("text"), "vec", "query_vec")
    return mmr.mmr(rows, group="label", item="vec_id")


@_register(query("SELECT label, unnest(kept) AS vec_id FROM (SELECT label, arg_max(kept, n) AS kept FROM dedupe GROUP BY label)", "dedupe"))
def greedy_dedupe(spark, sf_dir):
    return mmr.greedy_dedupe(_candidates(spark, sf_dir).select("label", "vec_id", F.col("vec_id").alias("pos"), "vec"), group="label", item="vec_id")


@_register(
    query(
        r"""SELECT question_id, regexp_replace(string_agg(sentence, ' ' ORDER BY answer_pos, sentence_id), '\[.*?\]', '', 'g') AS summary FROM filled
WHERE NOT contains(sentence, '?') AND NOT contains(sentence, 'example') AND len(ners) < 25 AND len(tokens) > 1 AND NOT regexp_matches(sentence, 'http\S+|www.\S+') GROUP BY question_id""",
        "filled",
    )
)
def summary_post_process(spark, sf_dir):
    return select.post_process(select.fill_gaps(_top(spark, sf_dir, Selection())), ["answer_pos", "sentence_id"])


def _expansion(spark, sf_dir) -> dict:
    """Regions and nations as the ontology, and the literal lexicon."""
    nodes = _nodes(spark, sf_dir).where("node_id NOT LIKE 'S%'")
    words, members, links = _lexicon(spark)
    return {"ontology": ontology.Ontology(nodes, _edges(spark, sf_dir).where("child_id NOT LIKE 'S%'")), "lexicon": expand.Lexicon(words, members, links)}


@_register()
def expanded_keywords(spark, sf_dir):
    """Questions' keywords with what the ontology and the lexicon add."""
    rows, _ = expand.expanded_keywords(spark, _tagged(spark, sf_dir), **_expansion(spark, sf_dir))
    return rows.select("question_id", "kw_pos", "keyword", *_r("weight"))


@_register()
def full_summary(spark, sf_dir):
    return summarize(spark, _t(spark, sf_dir, "conversations"), **_expansion(spark, sf_dir))


# evaluation


def _pairs(spark, sf_dir) -> DataFrame:
    """Each question with each of its answers."""
    c = _t(spark, sf_dir, "conversations")
    pair = (F.col("question_id") * 100000 + F.col("answer_id")).alias("pair_id")
    return corpus.questions(c).join(corpus.answers(c), "question_id").select(pair, F.col("question").alias("reference"), F.col("article").alias("hypothesis"))


@_register(query(f"SELECT pair_id, metric, {_rs('p', 'r', 'f')} FROM rouge1", "rouge1"))
def rouge_1(spark, sf_dir):
    return rouge.rouge_n(_pairs(spark, sf_dir), 1).select("pair_id", "metric", *_r("p", "r", "f"))


@_register(query(f"SELECT pair_id, metric, {_rs('p', 'r', 'f')} FROM rouge2", "rouge2"))
def rouge_2(spark, sf_dir):
    return rouge.rouge_n(_pairs(spark, sf_dir), 2).select("pair_id", "metric", *_r("p", "r", "f"))


@_register(query(f"SELECT pair_id, metric, {_rs('p', 'r', 'f')} FROM rougel", "rougel"))
def rouge_l(spark, sf_dir):
    return rouge.rouge_l(_pairs(spark, sf_dir)).select("pair_id", "metric", *_r("p", "r", "f"))


@_register(query("SELECT metric, round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f), 6) AS f FROM rouge GROUP BY metric", "rouge"))
def rouge_macro(spark, sf_dir):
    return rouge.macro_average(rouge.rouge(_pairs(spark, sf_dir))).select("metric", *_r("p", "r", "f"))


@_register(query(f"SELECT pair_id, round(max(CASE WHEN metric = 'rouge-1' THEN f END), 6) AS f1, round(max(CASE WHEN metric = 'rouge-l' THEN f END), 6) AS fl FROM rouge GROUP BY pair_id", "rouge"))
def rouge_nested(spark, sf_dir):
    m = rouge.nested(rouge.rouge(_pairs(spark, sf_dir)))
    return m.select("pair_id", F.round(F.col("scores")["rouge-1"]["f"], 6).alias("f1"), F.round(F.col("scores")["rouge-l"]["f"], 6).alias("fl"))


# ontology and expansion


def _nodes(spark, sf_dir) -> DataFrame:
    """Regions, nations and suppliers as ontology nodes."""
    part = lambda t, key, mark, terms: _t(spark, sf_dir, t).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("node_id"), terms.alias("terms"))
    lower = lambda c: F.lower(F.col(c))
    return (
        part("region", "r_regionkey", "R", F.array(lower("r_name")))
        .unionByName(part("nation", "n_nationkey", "N", F.array(lower("n_name"), F.concat(lower("n_name"), F.lit(" disease")))))
        .unionByName(part("supplier", "s_suppkey", "S", F.array(lower("s_name"))))
        .withColumn("tree_numbers", F.array(F.substring("node_id", 1, 1)))
    )


def _edges(spark, sf_dir) -> DataFrame:
    ref = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    up = _t(spark, sf_dir, "nation").select(ref("N", "n_nationkey").alias("node_id"), F.array(ref("R", "n_regionkey")).alias("parents"))
    rows = up.unionByName(_t(spark, sf_dir, "supplier").select(ref("S", "s_suppkey").alias("node_id"), F.array(ref("N", "s_nationkey"), F.lit("unknown")).alias("parents")))
    return ontology.parent_edges(rows, _nodes(spark, sf_dir))


@_register(query("SELECT parent_id, child_id FROM edge", "edge"))
def ontology_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@_register(query("SELECT DISTINCT p.node_id AS parent_id, c.node_id AS child_id FROM tree c JOIN tree p ON p.tree_number = regexp_replace(c.tree_number, '\\.[^.]*$', '') AND contains(c.tree_number, '.')", "tree"))
def tree_number_edges(spark, sf_dir):
    return ontology.tree_edges(X.frame(spark, X.TREE, "node_id string, tree_number string"))


@_register("SELECT lower(p_name) AS term, array_to_string(list_sort(list(DISTINCT 'P' || p_partkey)), ',') AS node_ids FROM part GROUP BY 1")
def term_index(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node_id"), F.array(F.lower("p_name")).alias("terms"))
    return ontology.term_index(nodes).select("term", F.array_join("node_ids", ",").alias("node_ids"))


@_register("SELECT p_partkey, substr(p_type, 1, 1) AS category FROM part WHERE substr(p_type, 1, 1) IN ('S', 'E')")
def category_filter(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").select("p_partkey", F.array("p_type").alias("tree_numbers"))
    return ontology.in_categories(nodes, ("S", "E")).select("p_partkey", F.col("category")[0].alias("category"))


@_register(query("SELECT DISTINCT src, dst FROM (SELECT a AS src, b AS dst FROM treated UNION ALL SELECT b, a FROM treated)", "treated"))
def relation_symmetric(spark, sf_dir):
    rows = X.frame(spark, X.CHEMICALS, "chemical_id string, disease_ref string, score double")
    return ontology.symmetric_relations(rows, X.frame(spark, X.XREFS, "xref string, node_id string")).select("src", "dst")


@_register("SELECT l_suppkey AS node_id, array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), ',') AS names FROM lineitem GROUP BY l_suppkey")
def annotation_union(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.col("l_partkey").cast("string").alias("name"))
    return ontology.union_annotations(rows).select("node_id", F.array_join("names", ",").alias("names"))


@_register(query("SELECT seed, node_id, round(weight, 6) AS weight FROM walk", "walk"))
def ontology_walk(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    seeds = nodes.select(F.col("node_id").alias("seed"), "node_id", F.lit(2.0).alias("weight"))
    return expand.ontology_walk(seeds, nodes, _edges(spark, sf_dir)).select("seed", "node_id", *_r("weight"))


@_register(
    query(
        """SELECT question_id, keyword, round(max(weight), 6) AS weight FROM (
  SELECT n_nationkey AS question_id, lower(n_name) AS keyword, 2.0::DOUBLE AS weight FROM nation UNION ALL
  SELECT CAST(substr(seed, 2) AS INTEGER), CASE WHEN contains(t, 'disease') THEN trim(replace(t, 'disease', '')) ELSE t END, weight FROM (SELECT seed, weight, unnest(terms) AS t FROM walk JOIN node USING (node_id) WHERE seed LIKE 'N%') UNION ALL
  SELECT s_nationkey, 'gene' || s_suppkey, 4.0 FROM supplier UNION ALL
  SELECT n_nationkey, lower(r_name), 2.0 FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY question_id, keyword""",
        "walk",
    )
)
def ontology_expand(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    ref = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    genes = _t(spark, sf_dir, "supplier").select(ref("N", "s_nationkey").alias("node_id"), ref("gene", "s_suppkey").alias("name"))
    relations = _t(spark, sf_dir, "nation").select(ref("N", "n_nationkey").alias("src"), ref("R", "n_regionkey").alias("dst"))
    links = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("question_id"), F.lower("n_name").alias("ner"), ref("N", "n_nationkey").alias("node_id"), F.lit(1.0).alias("weight"))
    return expand.expand_entities(links, ontology.Ontology(nodes, _edges(spark, sf_dir), relations, genes)).select("question_id", "keyword", *_r("weight"))


def _lexicon(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = X.frame(spark, X.LINKS, "a string, b string")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return X.frame(spark, X.WORDS, "word string, synset string"), X.frame(spark, X.MEMBERS, "synset string, token string"), both


@_register(query("SELECT seed, node, round(weight, 6) AS weight FROM synbest", "synbest"))
def wordnet_walk(spark, sf_dir):
    words, _, links = _lexicon(spark)
    seeds = words.select(F.col("word").alias("seed"), F.col("synset").alias("node"), F.lit(4.0).alias("weight"))
    return expand.synset_walk(spark, seeds, links).select("seed", "node", *_r("weight"))


@_register(
    query(
        f"""SELECT g.question_id, g.token AS origin, x.token, round(max(x.weight), 6) AS weight FROM given g JOIN
  (SELECT seed, lower(token) AS token, weight FROM synbest JOIN members ON synset = node WHERE NOT contains(token, ' ') AND NOT list_contains({STOP}, lower(token))) x ON x.seed = g.token
WHERE NOT EXISTS (SELECT 1 FROM given h WHERE h.question_id = g.question_id AND h.token = x.token) GROUP BY 1, 2, 3""",
        "synbest members given",
    )
)
def wordnet_expand(spark, sf_dir):
    words, members, links = _lexicon(spark)
    return expand.expand_words(spark, X.frame(spark, X.NOUNS, "question_id long, token string"), words, members, links).select("question_id", "origin", "token", *_r("weight"))


@_register(query("SELECT DISTINCT word, e.b AS synset, token FROM words JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = words.synset JOIN members ON members.synset = e.b", "words links members"))
def related_synsets(spark, sf_dir):
    return expand.related_synsets(*_lexicon(spark))


@_register(
    query(
        """SELECT word, array_to_string(list_sort(list(DISTINCT n.token)), ',') AS synonyms, coalesce(array_to_string(list_sort(list(DISTINCT f.antonym) FILTER (WHERE f.antonym IS NOT NULL)), ','), '') AS antonyms
FROM words JOIN members n ON n.synset = words.synset LEFT JOIN (SELECT token, min(antonym) AS antonym FROM antonyms GROUP BY token) f ON f.token = n.token GROUP BY word""",
        "words members antonyms",
    )
)
def synonym_sets(spark, sf_dir):
    words, members, _ = _lexicon(spark)
    rows = expand.synonyms(words, members, X.frame(spark, X.ANTONYMS, "token string, antonym string"))
    return rows.select("word", F.array_join("synonyms", ",").alias("synonyms"), F.array_join("antonyms", ",").alias("antonyms"))


@_register()
def fuzzy_entity_link(spark, sf_dir):
    """Nation names with a letter changed, linked to the nations."""
    nodes = _nodes(spark, sf_dir).where("node_id LIKE 'N%'")
    names = _t(spark, sf_dir, "nation").select(F.translate(F.lower("n_name"), "e", "a").alias("ner"))
    return expand.link_entities(names, nodes, Expansion()).select("ner", "node_id", "term", *_r("weight"))


@_register(query("SELECT (SELECT count(*) FROM node) AS n_nodes, (SELECT count(*) FROM edge) AS n_relations, (SELECT sum(len(terms)) FROM node) AS n_terms", "node edge"))
def graph_stats(spark, sf_dir):
    return ontology.graph_statistics(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@_register("SELECT 'p_brand' AS \"column\", count(*) AS n_rows, count(DISTINCT p_brand) AS n_distinct, count(*) - count(p_brand) AS n_null FROM part UNION ALL SELECT 'p_type', count(*), count(DISTINCT p_type), count(*) - count(p_type) FROM part")
def column_profile(spark, sf_dir):
    return ontology.column_profile(_t(spark, sf_dir, "part"), ["p_brand", "p_type"])


@_register(
    """SELECT node_id, array_to_string(terms, '|') AS terms FROM (
SELECT 'N' || n_nationkey AS node_id, CASE WHEN n_nationkey % 2 = 0 THEN [lower(n_name), lower(r_name)] ELSE [lower(n_name)] END AS terms FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'R' || r_regionkey, [lower(r_name)] FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 2 = 0))"""
)
def ontology_merge(spark, sf_dir):
    nations = _t(spark, sf_dir, "nation")
    ref = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    none = F.array().cast("array<string>")
    shape = lambda df, i, t: df.select(i.alias("node_id"), F.array(F.lower(t)).alias("terms"), none.alias("define_tokens"), none.alias("tree_numbers"))
    xrefs = nations.where("n_nationkey % 2 = 0").select(ref("R", "n_regionkey").alias("node_id"), F.concat(F.lit("MESH:"), ref("N", "n_nationkey")).alias("xref"))
    merged = ontology.xref_merge(shape(nations, ref("N", "n_nationkey"), "n_name"), shape(_t(spark, sf_dir, "region"), ref("R", "r_regionkey"), "r_name"), xrefs)
    return merged.select("node_id", F.array_join("terms", "|").alias("terms"))


# cleaning and sources


@_register(query("SELECT DISTINCT chemical_id, disease_ref, round(coalesce(score, (SELECT avg(score) FROM chem)), 6) AS score FROM chem", "chem"))
def ctd_fill_and_dedupe(spark, sf_dir):
    rows = X.frame(spark, X.CHEMICALS, "chemical_id string, disease_ref string, score double")
    return ontology.fill_and_dedupe(rows, "score").select("chemical_id", "disease_ref", *_r("score"))


@_register("SELECT p_type AS disease, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS genes FROM part GROUP BY p_type")
def group_gene_lists(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_type").alias("disease"), F.col("p_brand").alias("gene"))
    return ontology.gene_lists(rows).select("disease", F.array_join("genes", ",").alias("genes"))


@_register(query("SELECT f[1] AS question_id, CASE WHEN len(f) > 2 THEN array_to_string(f[2:len(f) - 1], ' ') ELSE f[2] END AS question FROM (SELECT string_split(value, '||') AS f FROM lines)", "lines"))
def delimited_parse(spark, sf_dir):
    key, body = readers.delimited_fields(F.col("value"))
    return X.frame(spark, [(x,) for x in X.DELIMITED], "value string").select(key.alias("question_id"), body.alias("question"))


@_register("SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)")
def embedding_missing_texts(spark, sf_dir):
    return readers.missing_texts(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"))


@_register(
    query(
        "SELECT q.question_id, question, a.answer_id, article FROM q JOIN a ON a.question_id = q.question_id", "q a"
    )
)
def assemble_sources(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return readers.assemble(corpus.questions(c), corpus.answers(c)).select("question_id", "question", "answer_id", "article")


@_register("SELECT quality, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def label_macro_average(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@_register()
def bipartite_components(spark, sf_dir):
    """The components over all of lineitem; a recursive closure in SQL grows with their square, so there is none."""
    pairs = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("u"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("v"))
    return graph.connected_components(spark, pairs)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
