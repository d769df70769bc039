"""DuckDB SQL for the queries: common table expressions that are put together by name."""

from __future__ import annotations

from ..functions.text import PUNCTUATION, SPACES, STOPWORDS
from . import fixtures as X

_q = lambda s: "'" + s.replace("'", "''") + "'"
STOP = "[" + ", ".join(map(_q, STOPWORDS)) + "]"


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, '[,:.;]? - ([A-Z])', '. \1', 'g')"
    x = rf"regexp_replace({x}, '[,:.;]? \t([A-Z])', '. \1', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[^\x00-\x7F]', ' ', 'g'), '0[0-9A-Za-z_]+', ' ', 'g')"
    x = f"translate({x}, chr(10) || chr(9), '')"
    for d in range(10):
        x = f"replace({x}, '[{d}]', '')"
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def normal(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({clean(x)}), {_q(PUNCTUATION)}, ''), '{SPACES}', ' ', 'g'), ' ')"


def tokens(normalized: str) -> str:
    return f"list_filter(string_split({normalized}, ' '), lambda t: t <> '' AND NOT list_contains({STOP}, t) AND NOT regexp_matches(t, '^[0-9]+$'))"


def pairs(t: str) -> str:
    return f"list_transform(list_filter(range(1, len({t})), lambda i: length({t}[i]) >= 4 AND length({t}[i + 1]) >= 4), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def segments(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({clean(x)}, '[^.?!]+[.?!]*'), lambda s: trim(s, ' ')), lambda s: s <> '')"


DANGLING = "list_filter(l, lambda s, i: NOT (i < len(l) AND ends_with(s, '?') AND NOT regexp_matches(coalesce(l[i + 1], ''), '^[A-Z]')))"


def minmax(v: str, by: str) -> str:
    top, low = f"greatest(max(round({v}, 9)) OVER (PARTITION BY {by}), 0.0)", f"least(min(round({v}, 9)) OVER (PARTITION BY {by}), 1e9)"
    return f"CASE WHEN {top} = {low} THEN 1.0 ELSE (round({v}, 9) - {low}) / ({top} - {low}) END"


K = "question_id, answer_id, sentence_id"
QA = "question_id, answer_id"

#: name: (what it needs, SQL)
PARTS: dict[str, tuple[str, str]] = {
    "q": ("", "SELECT conv_id AS question_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') GROUP BY conv_id"),
    "a": ("", "SELECT conv_id AS question_id, turn AS answer_id, turn AS answer_pos, text AS article FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user')"),
    "seg": ("a", f"SELECT question_id, answer_id, answer_pos, {segments('article')} AS l FROM a WHERE article IS NOT NULL"),
    "kept": ("seg", f"SELECT question_id, answer_id, answer_pos, {DANGLING} AS l FROM seg"),
    "sent": ("kept", "SELECT question_id, answer_id, answer_pos, CAST(i AS INTEGER) AS sentence_id, l[i] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM kept)"),
    "norm": ("sent", f"SELECT *, {normal('sentence')} AS normalized FROM sent"),
    "tok": ("norm", f"SELECT *, {tokens('normalized')} AS tokens FROM norm"),
    "s": ("tok", f"SELECT *, {pairs('tokens')} AS ners FROM tok"),
    "qn": ("q", f"SELECT *, {normal('question')} AS normalized FROM q"),
    "qk": ("qn", f"SELECT *, {tokens('normalized')} AS tokens FROM qn"),
    "qt": ("qk", f"SELECT *, {pairs('tokens')} AS ners FROM qk"),
    "qtok": ("qt", "SELECT question_id, len(ners) AS shift, i, tokens[i] AS token FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM qt)"),
    "nouns": ("qtok", "SELECT question_id, token, any_value(shift) + row_number() OVER (PARTITION BY question_id ORDER BY min(i)) - 1 AS pos FROM qtok GROUP BY question_id, token"),
    "kw": ("nouns qt", """SELECT question_id, keyword, CAST(min(pos) AS INTEGER) AS kw_pos, max(weight) AS weight FROM (
      SELECT question_id, token AS keyword, pos, CAST(4.0 AS DOUBLE) AS weight FROM nouns UNION ALL
      SELECT question_id, ners[i] AS keyword, i - 1 AS pos, CAST(2.0 AS DOUBLE) AS weight FROM (SELECT *, unnest(range(1, len(ners) + 1)) AS i FROM qt)) GROUP BY question_id, keyword"""),
    "tf": ("s", f"SELECT {K}, term, count(*) AS tf FROM (SELECT {K}, unnest(tokens) AS term FROM s) GROUP BY {K}, term"),
    "qsize": ("s", "SELECT question_id, count(*) AS n FROM s GROUP BY question_id"),
    "idf": ("tf qsize", "SELECT question_id, term, count(*) AS df, any_value(n) AS n, ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf JOIN qsize USING (question_id) GROUP BY question_id, term"),
    "tw": ("idf", f"SELECT {K}, term, tf * idf AS raw FROM tf JOIN idf USING (question_id, term)"),
    "tfidf": ("tw", f"SELECT {K}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {K})) AS tfidf FROM tw"),
    "fmax": ("tfidf", "SELECT question_id, term, round(max(tfidf), 12) AS value FROM tfidf GROUP BY question_id, term"),
    "cut": ("fmax", """SELECT question_id, value AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY value DESC, term) AS rn, count(*) OVER (PARTITION BY question_id) AS v FROM fmax)
      WHERE rn = floor(v * 0.7::DOUBLE) + 1"""),
    "terms": ("fmax", f"SELECT {K}, term, value FROM tf JOIN fmax USING (question_id, term)"),
    "boost": ("terms kw", f"""SELECT t.question_id, t.answer_id, t.sentence_id, t.term, arg_min(kw.weight, kw.kw_pos) AS weight FROM terms t
      JOIN s ON s.question_id = t.question_id AND s.answer_id = t.answer_id AND s.sentence_id = t.sentence_id
      JOIN kw ON kw.question_id = t.question_id AND contains(kw.keyword, t.term) AND (list_contains(s.tokens, kw.keyword) OR list_contains(s.ners, kw.keyword)) GROUP BY ALL"""),
    "b_none": ("terms", f"SELECT {K}, term, round(value, 9) AS b FROM terms"),
    "b_weight": ("boost", f"SELECT {K}, term, round(value * coalesce(weight, 1.0), 9) AS b FROM terms LEFT JOIN boost USING ({K}, term)"),
    "b_ner": ("terms qt", f"SELECT {K}, term, round(value + CASE WHEN len(list_filter(qt.ners, lambda n: contains(n, term))) > 0 THEN 2.0 ELSE 0.0 END, 9) AS b FROM terms JOIN qt USING (question_id)"),
    "mean": ("s", f"SELECT {K}, avg(len(tokens)) OVER (PARTITION BY question_id) AS mean FROM s"),
    "vocab": ("idf", "SELECT question_id, term, 1 / idf AS weight FROM idf"),
    "tf2": ("tf qt", f"SELECT {K}, term FROM tf UNION ALL SELECT DISTINCT question_id, -1, 0, unnest(tokens) FROM qt"),
    "vocab2": ("tf2 qsize", "SELECT question_id, term, 1 / (ln((2.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1) AS weight FROM tf2 JOIN qsize USING (question_id) GROUP BY question_id, term"),
    "rtf": ("s", f"SELECT {K}, term, count(*) AS tf FROM (SELECT {K}, unnest(list_filter(string_split(normalized, ' '), lambda t: t <> '' AND NOT list_contains({STOP}, t) AND NOT regexp_matches(t, '[0-9]'))) AS term FROM s) GROUP BY {K}, term"),
    "ridf": ("rtf", "SELECT term, df, n, ln(n / df) AS idf FROM (SELECT term, count(DISTINCT (question_id, answer_id)) AS df FROM rtf GROUP BY term), (SELECT count(DISTINCT (question_id, answer_id)) AS n FROM rtf)"),
    "rw": ("ridf", f"SELECT question_id, answer_id * 100000 + sentence_id AS node, term, tf * idf AS w FROM rtf JOIN ridf USING (term) WHERE idf > 0"),
    "rnorm": ("rw", "SELECT question_id, node, sqrt(sum(w * w)) AS norm FROM rw GROUP BY question_id, node"),
    "sim": ("rnorm", """SELECT question_id, a, b, round(dot / (x.norm * y.norm), 12) AS sim FROM (SELECT l.question_id, l.node AS a, r.node AS b, sum(l.w * r.w) AS dot FROM rw l JOIN rw r ON l.question_id = r.question_id AND l.term = r.term AND l.node < r.node GROUP BY ALL) d
      JOIN rnorm x ON x.question_id = d.question_id AND x.node = d.a JOIN rnorm y ON y.question_id = d.question_id AND y.node = d.b""".replace("SELECT question_id, a", "SELECT d.question_id AS question_id, a", 1)),
    "kwt": ("idf", f"SELECT question_id, answer_id * 100000 + sentence_id AS node, term, tf / idf AS w FROM tf JOIN idf USING (question_id, term)"),
    "knorm": ("kwt", "SELECT question_id, node, sqrt(sum(w * w)) AS norm FROM kwt GROUP BY question_id, node"),
    "ksim": ("knorm kw", """SELECT d.question_id AS question_id, a, b, round(dot / (x.norm * y.norm), 12) AS sim FROM (SELECT l.question_id, l.node AS a, r.node AS b, sum(l.w * coalesce(kw.weight, 1.0) * r.w) AS dot FROM kwt l JOIN kwt r ON l.question_id = r.question_id AND l.term = r.term AND l.node < r.node
      LEFT JOIN kw ON kw.question_id = l.question_id AND kw.keyword = l.term GROUP BY ALL) d
      JOIN knorm x ON x.question_id = d.question_id AND x.node = d.a JOIN knorm y ON y.question_id = d.question_id AND y.node = d.b"""),
    "e_thr": ("sim", "SELECT question_id, a, b, 1.0::DOUBLE AS w FROM sim WHERE sim > 0.065::DOUBLE"),
    "e_sim": ("sim", "SELECT question_id, a, b, sim AS w FROM sim WHERE sim > 0"),
    "e_kw": ("ksim", "SELECT question_id, a, b, 1.0::DOUBLE AS w FROM ksim WHERE sim > 0.065::DOUBLE"),
    "ratio": ("s kw dice", f"""SELECT {K}, coalesce(hit / (hit + missed), 0.0) AS raw FROM s LEFT JOIN (
      SELECT i.question_id, i.answer_id, i.sentence_id, sum(coalesce(w.weight, 0.0)) AS hit, sum(CASE WHEN coalesce(w.weight, 0.0) = 0 THEN 1.0 ELSE 0.0 END) AS missed FROM
      (SELECT {K}, unnest(list_concat(ners, list_distinct(list_filter(tokens, lambda t: NOT list_contains(ners, t))))) AS item FROM s) i LEFT JOIN dice w ON w.question_id = i.question_id AND w.item = i.item GROUP BY 1, 2, 3) USING ({K})"""),
    "items": ("s", "SELECT DISTINCT question_id, unnest(list_concat(ners, tokens)) AS item FROM s"),
    "dicepairs": ("items kw", """SELECT question_id, item, keyword, weight, (len(list_filter(x, lambda t: list_contains(y, t))) + len(list_filter(y, lambda t: list_contains(x, t)))) / (len(x) + len(y)) AS dice
      FROM (SELECT items.question_id AS question_id, item, keyword, weight, string_split(item, ' ') AS x, string_split(keyword, ' ') AS y FROM items JOIN kw ON kw.question_id = items.question_id AND len(list_intersect(string_split(item, ' '), string_split(keyword, ' '))) > 0)"""),
    "dice": ("dicepairs", "SELECT question_id, item, max(weight) AS weight FROM dicepairs WHERE dice >= 0.8::DOUBLE GROUP BY question_id, item"),
    "asked": ("nouns tf", "SELECT DISTINCT question_id, token AS q FROM nouns SEMI JOIN tf ON tf.question_id = nouns.question_id AND tf.term = nouns.token"),
    "qw": ("asked kw vocab", "SELECT f.question_id AS question_id, f.q AS q, f.kw * vocab.weight AS w FROM (SELECT asked.question_id, q, arg_min(kw.weight, kw_pos) AS kw FROM asked JOIN kw ON kw.question_id = asked.question_id AND contains(kw.keyword, q) GROUP BY asked.question_id, q) f JOIN vocab ON vocab.question_id = f.question_id AND vocab.term = f.q"),
    "mover": ("s qw", f"""SELECT {K}, CASE WHEN coalesce(total, 0.0) = 0 THEN 0.0 ELSE coalesce(hit, 0.0) / total END AS raw FROM s LEFT JOIN
      (SELECT tf.question_id, answer_id, sentence_id, sum(w) AS hit FROM tf JOIN qw ON qw.question_id = tf.question_id AND qw.q = tf.term GROUP BY 1, 2, 3) USING ({K}) LEFT JOIN (SELECT question_id, sum(w) AS total FROM qw GROUP BY 1) USING (question_id)"""),
    "qtf": ("qt", "SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(tokens) AS term FROM qt) GROUP BY 1, 2"),
    "ov": ("s vocab2 qtf", f"""SELECT {K}, coalesce(n1, 0.0) AS n1, coalesce(s1, 0.0) AS s1, coalesce(s2, 0.0) AS s2, coalesce(n2, 0.0) AS n2 FROM s LEFT JOIN
      (SELECT tf.question_id, answer_id, sentence_id, sum(tf * weight) AS n1, sum(CASE WHEN qtf IS NOT NULL THEN tf * weight ELSE 0.0 END) AS s1, sum(coalesce(qtf * weight, 0.0)) AS s2
       FROM tf JOIN vocab2 USING (question_id, term) LEFT JOIN qtf USING (question_id, term) GROUP BY 1, 2, 3) USING ({K})
      LEFT JOIN (SELECT question_id, sum(qtf * weight) AS n2 FROM qtf JOIN vocab2 USING (question_id, term) GROUP BY 1) USING (question_id)"""),
    "o_max": ("ov", f"SELECT {K}, CASE WHEN n1 * n2 = 0 THEN 0.0 ELSE greatest(s1 / n1, s2 / n2) END AS raw FROM ov"),
    "o_mean": ("ov", f"SELECT {K}, CASE WHEN n1 * n2 = 0 THEN 0.0 ELSE (s1 / n1 + s2 / n2) / 2 END AS raw FROM ov"),
    "query": ("o_max", f"SELECT {K}, raw, {minmax('byq', QA)} AS score FROM (SELECT *, {minmax('raw', 'question_id')} AS byq FROM o_max)"),
}


def _scored(name: str, raw: str) -> tuple[str, str]:
    return name, f"SELECT {K}, raw, {minmax('raw', QA)} AS score FROM {raw}"


def _topped(raw: str) -> tuple[str, str]:
    return raw, f"SELECT {K}, raw, {minmax('scaled', QA)} AS score FROM (SELECT *, CASE WHEN top <> 0 THEN raw / top ELSE raw END AS scaled FROM (SELECT *, max(raw) OVER (PARTITION BY {QA}) AS top FROM {raw}))"


for _mode in ("none", "weight", "ner"):
    PARTS[f"r_{_mode}"] = (f"b_{_mode} cut mean", f"""SELECT m.question_id AS question_id, m.answer_id AS answer_id, m.sentence_id AS sentence_id, coalesce(total / (1 + (greatest(CAST(coalesce(len, 0) AS DOUBLE), mean) - mean) / mean), 0.0) AS raw FROM mean m LEFT JOIN
      (SELECT b.question_id, answer_id, sentence_id, sum(CASE WHEN b >= round(threshold, 9) THEN b ELSE 0.0 END) AS total, count(*) AS len FROM b_{_mode} b JOIN cut ON cut.question_id = b.question_id GROUP BY 1, 2, 3) t
      ON t.question_id = m.question_id AND t.answer_id = m.answer_id AND t.sentence_id = m.sentence_id""")
    PARTS[f"tfidf_{_mode}"] = _scored(f"r_{_mode}", f"r_{_mode}")
for _mode in ("thr", "sim", "kw"):
    PARTS[f"reach_{_mode}"] = (f"e_{_mode}", f"""SELECT question_id, a AS x, b AS y FROM (SELECT question_id, a, b FROM e_{_mode} UNION ALL SELECT question_id, b, a FROM e_{_mode})
      UNION SELECT r.question_id, r.x, e.b FROM reach_{_mode} r JOIN (SELECT question_id, a, b FROM e_{_mode} UNION ALL SELECT question_id, b, a FROM e_{_mode}) e ON e.question_id = r.question_id AND e.a = r.y""")
    PARTS[f"comp_{_mode}"] = (f"s reach_{_mode}", f"SELECT s.question_id AS question_id, answer_id, sentence_id, answer_id * 100000 + sentence_id AS node, coalesce(least(m, answer_id * 100000 + sentence_id), answer_id * 100000 + sentence_id) AS component FROM s LEFT JOIN (SELECT question_id, x, min(y) AS m FROM reach_{_mode} GROUP BY 1, 2) r ON r.question_id = s.question_id AND r.x = answer_id * 100000 + sentence_id")
    PARTS[f"deg_{_mode}"] = (f"comp_{_mode}", f"SELECT c.*, 1 + coalesce(w, 0.0) AS w FROM comp_{_mode} c LEFT JOIN (SELECT question_id, n, sum(w) AS w FROM (SELECT question_id, a AS n, w FROM e_{_mode} UNION ALL SELECT question_id, b, w FROM e_{_mode}) GROUP BY 1, 2) d ON d.question_id = c.question_id AND d.n = c.node")
    PARTS[f"rank_{_mode}"] = (f"deg_{_mode}", f"SELECT {K}, component, count(*) OVER (PARTITION BY question_id, component) * w / sum(w) OVER (PARTITION BY question_id, component) AS raw FROM deg_{_mode}")
    PARTS[f"lex_{_mode}"] = _scored(f"rank_{_mode}", f"rank_{_mode}")
PARTS["keyword"] = _topped("ratio")
PARTS["moved"] = _topped("mover")
PARTS["fused"] = ("tfidf_weight lex_thr keyword moved query", f"""SELECT {K}, t.score AS tfidf, l.score AS lexrank, k.score AS keyword, m.score AS mover, u.score AS query, (4.0 * t.score + 2.0 * l.score + 2.0 * k.score + 3.0 * m.score + 3.0 * u.score) / 14.0 AS mix
  FROM tfidf_weight t JOIN lex_thr l USING ({K}) JOIN keyword k USING ({K}) JOIN moved m USING ({K}) JOIN query u USING ({K})""")
PARTS["final"] = ("fused", f"SELECT {K}, tfidf, lexrank, keyword, mover, query, {minmax('mix', 'question_id')} AS final FROM fused")
PARTS["ranked"] = ("s tfidf_none", f"SELECT s.*, t.score AS score, row_number() OVER (PARTITION BY {QA} ORDER BY round(t.score, 9) DESC, sentence_id) AS rank, count(*) OVER (PARTITION BY {QA}) AS n, sum(CASE WHEN round(t.score, 9) >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {QA}) AS over FROM s JOIN tfidf_none t USING ({K})")
for _kind, _k in (("num", "least(5, n)"), ("ratio", "floor(n * 0.3::DOUBLE)"), ("threshold", "over")):
    PARTS[f"top_{_kind}"] = ("ranked", f"SELECT *, rank <= greatest({_k}, 1) + 1 AND len(tokens) >= 2 AS chosen FROM ranked")
PARTS["filled"] = ("top_num", f"""SELECT * FROM (SELECT *, last_value(CASE WHEN chosen THEN sentence_id END IGNORE NULLS) OVER (PARTITION BY {QA} ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bef,
  first_value(CASE WHEN chosen THEN sentence_id END IGNORE NULLS) OVER (PARTITION BY {QA} ORDER BY sentence_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM top_num) WHERE aft - bef <= 3 OR aft <= 3""")
PARTS["merged"] = ("filled", "SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY answer_pos, sentence_id) AS INTEGER) AS merged_id FROM filled")
PARTS["rp"] = ("q a", "SELECT q.question_id * 100000 + answer_id AS pair_id, question AS reference, article AS hypothesis FROM q JOIN a ON a.question_id = q.question_id")
_rt = lambda x: f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
PARTS["rtok"] = ("rp", f"SELECT pair_id, {_rt('reference')} AS a, {_rt('hypothesis')} AS b FROM rp")
_prf = "CASE WHEN nh > 0 THEN hits / nh ELSE 0.0 END AS p, CASE WHEN nr > 0 THEN hits / nr ELSE 0.0 END AS r"
_f = "SELECT pair_id, metric, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f"
for _n in (1, 2):
    PARTS[f"g{_n}"] = ("rtok", f"""SELECT pair_id, g, sum(x) AS nr, sum(y) AS nh FROM (
      SELECT pair_id, array_to_string(a[i:i + {_n - 1}], ' ') AS g, 1 AS x, 0 AS y FROM (SELECT *, unnest(range(1, len(a) - {_n - 2})) AS i FROM rtok) UNION ALL
      SELECT pair_id, array_to_string(b[i:i + {_n - 1}], ' ') AS g, 0, 1 FROM (SELECT *, unnest(range(1, len(b) - {_n - 2})) AS i FROM rtok)) GROUP BY pair_id, g""")
    PARTS[f"rouge{_n}"] = (f"g{_n}", f"{_f} FROM (SELECT pair_id, 'rouge-{_n}' AS metric, {_prf} FROM (SELECT pair_id, coalesce(sum(least(nr, nh)), 0) AS hits, coalesce(sum(nr), 0) AS nr, coalesce(sum(nh), 0) AS nh FROM rtok LEFT JOIN g{_n} USING (pair_id) GROUP BY pair_id))")
PARTS["dp"] = ("rtok", """SELECT pair_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS l FROM rtok UNION ALL
  SELECT pair_id, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [greatest(l[j + 1], CASE WHEN b[j] = a[i + 1] THEN l[j] + 1 ELSE 0 END)]), lambda done, c: list_append(done, greatest(done[-1], c[1])), [0]) FROM dp WHERE i < len(a)""")
PARTS["rougel"] = ("dp", f"{_f} FROM (SELECT pair_id, 'rouge-l' AS metric, {_prf} FROM (SELECT pair_id, l[-1] AS hits, len(a) AS nr, len(b) AS nh FROM dp WHERE i = len(a)))")
PARTS["rouge"] = ("rouge1 rouge2 rougel", "SELECT * FROM rouge1 UNION ALL SELECT * FROM rouge2 UNION ALL SELECT * FROM rougel")
PARTS["vec"] = ("", "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
PARTS["vq"] = ("vec", "SELECT label, min(vec_id) AS qid, arg_min(v, vec_id) AS qv FROM vec GROUP BY label")
PARTS["cand"] = ("vq", "SELECT vec.label AS label, vec_id, v, qv, round(list_cosine_similarity(v, qv), 12) AS q FROM vec JOIN vq ON vq.label = vec.label AND vec_id <> qid")
PARTS["pairs"] = ("cand", "SELECT x.label AS label, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 12) AS sim FROM cand x JOIN cand y ON x.label = y.label AND x.vec_id <> y.vec_id")
PARTS["picks"] = ("pairs", """SELECT label, 0 AS step, CAST([] AS BIGINT[]) AS picked FROM vq UNION ALL
  SELECT label, step + 1, list_append(picked, best) FROM (SELECT label, step, picked, arg_max(vec_id, (score, -vec_id)) AS best FROM (
    SELECT p.label, p.step, p.picked, c.vec_id, CASE WHEN p.step = 0 THEN round(0.85::DOUBLE * any_value(c.q), 9) WHEN max(w.sim) >= 0.9::DOUBLE THEN 0.0 ELSE round(0.85::DOUBLE * any_value(c.q) - (1 - 0.85::DOUBLE) * max(w.sim), 9) END AS score
    FROM picks p JOIN cand c ON c.label = p.label AND NOT list_contains(p.picked, c.vec_id) LEFT JOIN pairs w ON w.label = c.label AND w.a = c.vec_id AND list_contains(p.picked, w.b) WHERE p.step < 25 GROUP BY p.label, p.step, p.picked, c.vec_id) GROUP BY label, step, picked)""")
PARTS["dedupe"] = ("pairs", """SELECT label, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS kept FROM vq UNION ALL
  SELECT d.label, d.n + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs w WHERE w.label = d.label AND w.a = o.vec_id AND list_contains(d.kept, w.b) AND w.sim >= 0.9::DOUBLE) THEN d.kept ELSE list_append(d.kept, o.vec_id) END
  FROM dedupe d JOIN (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM cand) o ON o.label = d.label AND o.rn = d.n + 1""")
PARTS["node"] = ("", "SELECT 'R' || r_regionkey AS node_id, [lower(r_name)] AS terms FROM region UNION ALL SELECT 'N' || n_nationkey, [lower(n_name), lower(n_name) || ' disease'] FROM nation UNION ALL SELECT 'S' || s_suppkey, [lower(s_name)] FROM supplier")
PARTS["edge"] = ("", "SELECT 'R' || n_regionkey AS parent_id, 'N' || n_nationkey AS child_id FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier")
_both = "(SELECT a, b FROM links UNION ALL SELECT b, a FROM links)"
for _name, _rows, _cols in (("words", X.WORDS, "word, synset"), ("members", X.MEMBERS, "synset, token"), ("links", X.LINKS, "a, b"), ("antonyms", X.ANTONYMS, "token, antonym"), ("given", X.NOUNS, "question_id, token"), ("tree", X.TREE, "node_id, tree_number"), ("chem", X.CHEMICALS, "chemical_id, disease_ref, score"), ("xref", X.XREFS, "xref, node_id"), ("lines", [(x,) for x in X.DELIMITED], "value")):
    PARTS[_name] = ("", f"SELECT * FROM (VALUES {X.values(_rows, 'x').split('VALUES ', 1)[1][:-1]}) AS t({_cols})")
PARTS["treated"] = ("chem xref", """SELECT chemical_id AS a, split_part(disease_ref, ':', 2) AS b FROM chem WHERE split_part(disease_ref, ':', 1) = 'MESH'
  UNION ALL SELECT chemical_id, node_id FROM chem JOIN xref ON xref = disease_ref WHERE split_part(disease_ref, ':', 1) <> 'MESH'""")
PARTS["syn"] = ("words links", f"""SELECT word AS seed, synset AS node, 4.0::DOUBLE AS weight FROM words UNION ALL
  SELECT seed, e.b, weight * 0.8::DOUBLE / d.n FROM syn JOIN {_both} e ON e.a = syn.node JOIN (SELECT a, count(*) AS n FROM {_both} GROUP BY a) d ON d.a = syn.node WHERE weight * 0.8::DOUBLE / d.n >= 1""")
PARTS["synbest"] = ("syn", "SELECT seed, node, max(weight) AS weight FROM syn GROUP BY seed, node")
PARTS["seeds"] = ("", "SELECT 'N' || n_nationkey AS seed, 'N' || n_nationkey AS node_id, 2.0::DOUBLE AS weight FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, 2.0 FROM region UNION ALL SELECT 'S' || s_suppkey, 'S' || s_suppkey, 2.0 FROM supplier")
PARTS["walk"] = ("seeds edge node", """SELECT seed, node_id, max(weight) AS weight FROM (SELECT seed, node_id, weight FROM seeds UNION ALL
  SELECT seed, parent_id, 0.7::DOUBLE * (weight / n) FROM seeds JOIN (SELECT *, count(*) OVER (PARTITION BY child_id) AS n FROM edge) ON child_id = node_id WHERE 0.7::DOUBLE * (weight / n) > 1 UNION ALL
  SELECT seed, child_id, 0.7::DOUBLE * (weight / n) FROM seeds JOIN (SELECT *, count(*) OVER (PARTITION BY parent_id) AS n FROM edge) ON parent_id = node_id WHERE 0.7::DOUBLE * (weight / n) > 1) GROUP BY seed, node_id""")

_RECURSIVE = {"dp", "picks", "dedupe", "syn", "reach_thr", "reach_sim", "reach_kw"}


def query(final: str, needs: str) -> str:
    """WITH all that `needs` leads to, then the final SELECT."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for x in PARTS[name][0].split():
            visit(x)
        order.append(name)

    for x in needs.split():
        visit(x)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + final
