"""URL filters: fixed host and path rules, and association rules mined from labels.

Labelled pages are transactions of URL tokens (host labels and path segments) plus their label. The smallest sets that
conclude `block` with enough support and confidence, on pages held back as well, are mined level by level, of all frequent
tokens of a page. A rule is indexed under its rarest token, and a URL is checked only against the rules that one of its
tokens leads to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, materialize

#: Rule text (host and path prefix) and verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Share and number of labelled pages that hold a rule's tokens and its label, and share of `block` among its pages.
SUPPORT, MIN_COUNT, CONFIDENCE = 0.002, 5, 0.6
#: Tokens of a page that the SQL goes through, as it lists all of their sets; mining has no such bound.
MAX_ITEMS = 12


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// to / ? # or the end, A-Z lower-cased. Path: from there to ? # or the end. Else empty."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", u) > 0, u.substr(F.locate("://", u) + 3, F.length(u)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels (h:) and path segments (p:)."""
    own = lambda x, sep, mark: F.transform(F.filter(F.split(x, sep), lambda s: s != ""), lambda s: F.concat(F.lit(mark), s))
    return F.array_distinct(F.concat(own(host, "[.]", "h:"), own(path, "/", "p:")))


def held_back(page_id: Column) -> Column:
    """True for the pages, five of sixteen, that rules are measured on and not mined from."""
    return F.substring(F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary")), 1, 1) < "5"


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, own, mark, held): the tokens and mark of each distinct page that has the id of a label.

    A page counts as `block` if its quality is 0 or it is toxic; labels and pages share their ids.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow")).alias("mark"))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").distinct().join(marks, F.col("page_id") == F.col("doc_id"))
    return rows.select(F.xxhash64("page_id", "url").alias("page"), tokens(host, path).alias("own"), "mark", held_back(F.col("page_id")).alias("held"))


COUNTS = ("n", "b", "m", "c")


def token_classes(seen: DataFrame, least: int) -> DataFrame:
    """(token, item, n, b, m, c): tokens of at least `least` pages to block, and the least token on just the same pages.

    Tokens on the same labelled pages have the same counts in any set, so one stands for all of them in mining. n and b are
    the pages mined and those of them to block, m and c the same of the pages held back.
    """
    each = seen.select("page", F.explode("own").alias("token"), *counted())
    own = each.groupBy("token").agg(*[F.sum(x).alias(x) for x in COUNTS], F.bit_xor(F.xxhash64("page", F.lit(1))).alias("h1"), F.bit_xor(F.xxhash64("page", F.lit(2))).alias("h2"))
    own = own.where(F.col("b") >= least)
    least_of = own.groupBy("h1", "h2", *COUNTS).agg(F.min("token").alias("item"), F.collect_list("token").alias("all"))
    return least_of.select(F.explode("all").alias("token"), "item", *COUNTS)


def counted() -> list[Column]:
    one = lambda x: F.when(x, 1).otherwise(0).cast("long")
    held, block = F.col("held"), F.col("mark") == "block"
    return [one(~held).alias("n"), one(~held & block).alias("b"), one(held).alias("m"), one(held & block).alias("c")]


def smallest_rules(spark: SparkSession, seen: DataFrame, classes: DataFrame, least: int, confidence: float) -> list[DataFrame]:
    """(antecedent) by size: sets of items, none of which holds another, that are rules on the pages mined and held back.

    A set is extended if it could still be part of a smallest rule: enough pages to block, some of those held back, not a
    rule itself, and on fewer pages than any set of one item less (else that set has the same counts). All of this holds
    for every part of a smallest rule, so no rule is missed; equal rests of pages are summed up before they are extended.
    """
    rows = seen.select("page", F.explode("own").alias("token"), *counted()).join(classes.select("token", "item"), "token")
    rows = rows.groupBy("page", *COUNTS).agg(F.sort_array(F.collect_set("item")).alias("rest"))
    pages = rows.groupBy(F.array().cast("array<string>").alias("set"), "rest").agg(*[F.sum(x).alias(x) for x in COUNTS])
    former, parts, size, rules = None, materialize(spark, pages, "url-sets"), 0, []
    while True:
        at = parts.select("set", F.posexplode("rest").alias("i", "item"), "rest", *COUNTS)
        at = at.select(F.concat("set", F.array("item")).alias("set"), F.expr("slice(rest, i + 2, size(rest))").alias("rest"), *COUNTS)
        longer = materialize(spark, at.groupBy("set", "rest").agg(*[F.sum(x).alias(x) for x in COUNTS]), "url-sets")
        size += 1
        sets = longer.groupBy("set").agg(*[F.sum(x).alias(x) for x in COUNTS])
        sets = sets.where((F.col("b") >= least) & (F.col("m") > 0) & (F.col("c") >= (1 if confidence > 0 else 0)))
        if former is not None:
            less = sets.select("set", (F.col("n") + F.col("m")).alias("pages"), F.explode(F.expr(f"transform(sequence(1, {size}), k -> concat(slice(set, 1, k - 1), slice(set, k + 1, {size})))")).alias("part"))
            fewer = less.join(former.select(F.col("set").alias("part"), (F.col("n") + F.col("m")).alias("part_pages")), "part").where("pages < part_pages")
            sets = sets.join(fewer.groupBy("set").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") == size).select("set"), "set", "left_semi")
        told = (F.col("b") >= F.lit(confidence) * F.col("n")) & (F.col("c") >= F.lit(confidence) * F.col("m"))
        sets = materialize(spark, sets.withColumn("rule", told), "url-set-counts")
        rules.append(sets.where("rule").select(F.col("set").alias("antecedent")))
        open_sets = sets.where("NOT rule")
        if not open_sets.limit(1).count():
            discard(spark, parts, longer)
            return rules
        following = longer.where("size(rest) > 0").join(open_sets.select("set"), "set", "left_semi")
        if size == 1:  # an item that is a rule, or never part of one, is in no longer rule
            kept = following.withColumn("item", F.explode("rest")).join(open_sets.select(F.col("set")[0].alias("item")), "item", "left_semi")
            following = kept.groupBy("set", F.col("rest").alias("whole"), *COUNTS).agg(F.sort_array(F.collect_list("item")).alias("rest")).drop("whole")
        discard(spark, parts)
        former, parts = open_sets, materialize(spark, following, "url-sets")
        discard(spark, longer)


def by_rarest(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, antecedent, any): each rule under all tokens of its rarest item, with the tokens of each of its items."""
    items = classes.groupBy("item", "n").agg(F.collect_list("token").alias("tokens"))
    keyed = rules.select("antecedent", F.explode("antecedent").alias("item")).join(items, "item")
    rarest = keyed.groupBy("antecedent").agg(F.min(F.struct("n", "item", "tokens")).alias("rarest"), F.collect_list("tokens").alias("any"))
    return rarest.select(F.explode("rarest.tokens").alias("token"), "antecedent", "any")


def matching(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows(own, ..) with the antecedent of every rule of the index of which they hold a token of each item."""
    return rows.withColumn("token", F.explode("own")).join(index, "token").where(F.forall("any", lambda x: F.arrays_overlap(x, F.col("own")))).drop("token", "any")


def mine_rules(spark: SparkSession, pages: DataFrame, labels: DataFrame, support: float = SUPPORT, min_count: int = MIN_COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """(token, antecedent, any): block rules under their rarest token.

    The labelled pages that aren't held back are mined; a rule stays if at least one page held back has its tokens and its
    confidence holds on these as well. No rule holds all of another's items, as it would block nothing more. An item stands
    for all tokens on the same labelled pages (any). Without labelled pages there are no rules.
    """
    seen = materialize(spark, labelled(pages, labels), "labelled-pages")
    least = max(min_count, math.ceil(support * seen.where("NOT held").count()))
    classes = materialize(spark, token_classes(seen, least), "token-classes")
    first, *more = smallest_rules(spark, seen, classes, least, confidence)
    for x in more:
        first = first.unionByName(x)
    return materialize(spark, by_rarest(first, classes), "rules")


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    The longest fixed rule that fits decides; else a mined rule blocks; else the page is allowed (null rule). Null urls
    and urls without :// have empty host and path and are allowed. Distinct urls are judged once; repeated rows get the
    same verdict through a join that Spark may split on the pages' side. Other columns aren't read.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = rows.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    fixed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(r.split("/", 1)[0]).alias("rule_host"), F.lit("/" + r.split("/", 1)[1]).alias("rule_path"), F.lit(v).alias("rule_verdict")) for r, v in rules])))
    labels_of = F.split("host", "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels_of)), lambda i: F.array_join(F.slice(labels_of, i, F.size(labels_of)), "."))
    fitting = urls.select("url", "path", F.explode(ends).alias("rule_host")).join(fixed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    longest = fitting.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    index = mine_rules(spark, pages, labels)
    own = urls.select("url", tokens(F.col("host"), F.col("path")).alias("own"))
    blocked = matching(own, index).select("url").distinct().withColumn("mined", F.lit("block"))
    verdicts = urls.join(longest, "url", "left").join(blocked, "url", "left")
    verdicts = verdicts.select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", "mined", F.lit("allow")).alias("verdict"))
    return rows.join(verdicts, "url").select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || x))) AS own FROM h),
m AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 'block' ELSE 'allow' END) AS mark FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
s AS (SELECT row_number() OVER () AS r, own, mark, substr(md5(CAST(page_id AS VARCHAR)), 1, 1) < '5' AS held FROM (SELECT DISTINCT page_id, url, own, mark FROM t JOIN m ON m.doc_id = t.page_id)),
n AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE mark = 'block') AS b_all, greatest(ceil({SUPPORT} * count(*)), {MIN_COUNT}) AS least FROM s WHERE NOT held),
e AS (SELECT r, mark, unnest(own) AS x FROM s WHERE NOT held),
f AS (SELECT x, abs(count(*) FILTER (WHERE mark = 'block') * (SELECT n_all FROM n) - count(*) * (SELECT b_all FROM n)) AS told FROM e GROUP BY x HAVING count(*) >= (SELECT least FROM n)),
k AS (SELECT r, mark, list(x ORDER BY x) AS own FROM (SELECT r, mark, x FROM e JOIN f USING (x) QUALIFY row_number() OVER (PARTITION BY r ORDER BY told DESC, x) <= {MAX_ITEMS}) GROUP BY r, mark),
subs AS (SELECT mark, own, unnest(range(1, CAST(power(2, len(own)) AS BIGINT))) AS bits FROM k),
sets AS (SELECT mark, list_filter(own, lambda x, i: (bits >> (i - 1)) & 1 = 1) AS items FROM subs),
told AS (SELECT items FROM sets GROUP BY items HAVING count(*) FILTER (WHERE mark = 'block') >= (SELECT least FROM n) AND count(*) FILTER (WHERE mark = 'block') >= {CONFIDENCE} * count(*)),
mined AS (SELECT items FROM told JOIN s ON s.held AND list_has_all(s.own, told.items) GROUP BY items HAVING count(*) FILTER (WHERE mark = 'block') >= {CONFIDENCE} * count(*)),
fixed(rule, rule_host, rule_path, v) AS (VALUES {', '.join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in RULES)}),
best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM (SELECT DISTINCT host, path FROM t) p
  JOIN fixed ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT t.page_id, t.host, t.path, best.rule, coalesce(best.v, CASE WHEN EXISTS (SELECT 1 FROM mined WHERE list_has_all(t.own, mined.items)) THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN best ON best.host = t.host AND best.path = t.path
"""
