"""Benchmark decontamination by a distributed positional inverted index.

The postings of the corpus, (term, row, position) of every word that some test window has, are written once, by the tasks
that read the texts; after that no text is read or shuffled. The postings' counts give each test term's frequency. The
list of a window's rarest term, moved back by that term's offset, gives the places where the window could start; these are
intersected with the moved list of the next rarest term, and what is left with those of all other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, if_small, lower_ascii, materialize, quoted

SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LENGTH = 8
#: Bytes of test terms, and rows of candidates or windows, up to which they are broadcast; beyond, the same joins shuffle.
TERM_BYTES, MAX_BROADCAST = 16 << 20, 200_000


def words_of(text: Column) -> Column:
    """Words of A-Z-lower-cased text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def test_windows(spark: SparkSession, benchmark: DataFrame, length: int = LENGTH, text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Written tables of windows(window, terms) and their items(window, item).

    A window is `length` consecutive words of an item, or all words of a shorter item; equal windows are one.
    """
    rows = benchmark.where(quoted(item_id).isNotNull()).select(quoted(item_id).cast("string").alias("item"), words_of(quoted(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    each = materialize(spark, rows.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(length)))).alias("terms")).distinct(), "item-windows")
    windows = materialize(spark, each.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"), "test-windows")
    items = materialize(spark, each.join(windows, "terms").select("window", "item"), "window-items")
    discard(spark, each)
    return windows, items


def post(spark: SparkSession, docs: DataFrame, windows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Written tables of the terms(term, word) that windows have and of the postings(row, id, term, pos) of docs.

    `row` numbers the rows of docs, so that repeated rows stay apart. Each row of docs has one posting of the null term, with
    its id and, as the position, its number of words. Only a table of terms over TERM_BYTES makes the words shuffle.
    """
    words = windows.select(F.explode("terms").alias("word")).distinct()
    terms = materialize(spark, words.select(F.monotonically_increasing_id().alias("term"), "word"), "test-terms")
    size = terms.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("id"), words_of(quoted(text)).alias("w"))
    said = rows.select("row", "id", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))  # the last one, empty, ends the text
    known = terms.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("term"), F.lit("").alias("word")))
    found = said.join(F.broadcast(known) if size <= TERM_BYTES else known, "word")
    return terms, materialize(spark, found.select("row", F.when(F.col("term").isNull(), F.col("id")).alias("id"), "term", "pos"), "postings")


def by_rarity(spark: SparkSession, windows: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Written table (window, n, lists): a window's (frequency, offset, term) lists, the rarest first; windows with a term that the corpus lacks go."""
    frequency = postings.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = windows.select("window", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "word")).join(terms, "word").join(frequency, "term")
    lists = each.groupBy("window").agg(F.first("n_terms").alias("n"), F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("lists"))
    return materialize(spark, lists.where(F.size("lists") == F.col("n")), "rarest-terms")


def places(spark: SparkSession, windows: DataFrame, postings: DataFrame, slop: int = 0) -> DataFrame:
    """(row, window, start, n, exact): where windows stand, from the lists of by_rarity and the postings.

    Exact: each term at start + its offset. With slop > 0 there are proximity places as well: the rarest term is at its own
    place, every other term at most `slop` words from its own, and no posting serves two terms.
    """
    near = lambda df: if_small(df, MAX_BROADCAST)
    lists = postings.where("term IS NOT NULL").select("row", "term", "pos")
    first = F.col("lists")[0]
    anchors = near(windows.select(first["term"].alias("term"), first["offset"].alias("offset"), "window"))
    start = lists.join(anchors, "term").select("row", "window", (F.col("pos") - F.col("offset")).alias("start"))
    if not slop:
        start = start.where("start >= 0")
    start = materialize(spark, start, "places")
    if slop:
        return _near_places(spark, windows, lists, start, slop)

    def moved(df: DataFrame, part: Column) -> DataFrame:
        """df(row, window, start) with the term and position that each list of its window must hold, and how many these are."""
        wanted = near(windows.where(F.size("lists") > 1).select("window", part.alias("part")).where(F.size("part") > 0))
        return df.join(wanted, "window").select("row", "window", "start", F.size("part").alias("due"), F.explode("part").alias("x")).select("row", "window", "start", "due", F.col("x.term").alias("term"), (F.col("start") + F.col("x.offset")).cast("int").alias("pos"))

    def meet(df: DataFrame, by: str) -> DataFrame:
        """The postings that df asks for; a df too large for a broadcast first narrows them down by one column."""
        if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
            return lists.join(F.broadcast(df), ["row", "term", "pos"])
        return lists.join(near(df.select(by).distinct()), by, "left_semi").join(df, ["row", "term", "pos"])

    # the second rarest alone first, since it leaves few places over; then all others at once
    left = materialize(spark, meet(moved(start, F.slice("lists", 2, 1)), "term").select("row", "window", "start"), "places")
    third = meet(moved(left, F.slice("lists", 3, 1 << 20)), "row")
    whole = third.groupBy("row", "window", "start").agg(F.count(F.lit(1)).alias("found"), F.first("due").alias("due")).where("found = due")
    size = windows.select("window", "n")
    short = left.join(near(size.where("n = 2")), "window").select("row", "window", "start").unionByName(start.join(near(size.where("n = 1")), "window").select("row", "window", "start"))
    both = whole.select("row", "window", "start").unionByName(short).join(near(size), "window")
    return both.select("row", "window", "start", "n", F.lit(True).alias("exact"))


def _near_places(spark: SparkSession, windows: DataFrame, lists: DataFrame, start: DataFrame, slop: int) -> DataFrame:
    """As places, each start being the one of an anchor. A term's postings near a start are few: those within its own offsets' reach."""
    rest = windows.select("window", "n", F.slice("lists", 1, 1)[0]["offset"].alias("anchor"), F.explode("lists").alias("x"))
    wanted = rest.groupBy("window", "n", "anchor", F.col("x.term").alias("term")).agg(F.array_sort(F.collect_list("x.offset")).alias("offsets"))
    wanted = materialize(spark, wanted, "window-terms")
    # the places that a term may have about a start, one row each, met by equality
    reach = F.array_distinct(F.flatten(F.transform("offsets", lambda o: F.transform(F.sequence(o - slop, o + slop), lambda k: (F.col("start") + k).cast("int")))))
    asked = start.join(if_small(wanted, MAX_BROADCAST), "window").select("row", "window", "start", "term", F.explode(reach).alias("pos")).where("pos >= 0")
    held = lists.join(asked, ["row", "term", "pos"]).groupBy("row", "window", "start", "term").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    told = held.join(if_small(wanted, MAX_BROADCAST), ["window", "term"])
    anchor = F.when(F.array_contains("offsets", F.col("anchor")), (F.col("start") + F.col("anchor")).cast("int"))
    free = F.when(anchor.isNull(), F.col("at")).otherwise(F.filter("at", lambda p: p != anchor))
    others = F.when(anchor.isNull(), F.col("offsets")).otherwise(F.filter("offsets", lambda o: o != F.col("anchor")))
    # the offsets in order take the first posting behind the last one taken: all reaches are equally wide, so this finds places for all if any choice does
    took = F.aggregate(
        others, F.lit(-1),
        lambda last, o: F.when(last.isNull(), last).otherwise(F.array_min(F.filter(free, lambda p: (p > last) & (F.abs(p - F.col("start") - o) <= slop)))).cast("int"),
    )
    exact = F.forall("offsets", lambda o: F.array_contains("at", (F.col("start") + o).cast("int")))
    placed = told.select("row", "window", "start", "n", "term", F.size("offsets").alias("terms"), exact.alias("exact"), took.isNotNull().alias("ok")).where("ok")
    whole = placed.groupBy("row", "window", "start", "n").agg(F.sum("terms").alias("found"), F.min("exact").alias("exact")).where("found = n")
    return whole.select("row", "window", "start", "n", "exact")


def phrase_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, slop: int = 0, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(row, id, n_words, start, n, exact, items): a row with null start for each document, and one for each match.

    A match is exact if the window's terms follow each other from `start` on; with slop > 0 proximity matches come as well
    (see places). `items` are the distinct items that have the window, in order.
    """
    windows, items = test_windows(spark, benchmark, length, text, item_id)
    terms, postings = post(spark, docs, windows, text, doc_id)
    found = materialize(spark, places(spark, by_rarity(spark, windows, terms, postings), postings, slop), "matches")
    ends = postings.where("term IS NULL").select("row", "id", F.col("pos").cast("long").alias("n_words"))
    named = items.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = found.join(if_small(named, MAX_BROADCAST // 10), "window")
    every = ends.select("*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("boolean").alias("exact"), F.lit(None).cast("array<string>").alias("items"))
    return every.unionByName(ends.join(hits, "row").select("row", "id", "n_words", F.greatest("start", F.lit(0)).cast("int").alias("start"), "n", "exact", "items"))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_items >= 2) of each row of docs.

    A word inside any occurrence of a window is hit, counted once. Null and wordless texts have no words and no hits;
    items without words or id are passed over; repeated rows and ids are judged each; other columns, whatever their names,
    aren't read. What meets per document is its row, its distinct hit positions and its items.
    """
    windows, items = test_windows(spark, benchmark, length, text)
    terms, postings = post(spark, docs, windows, text, doc_id)
    found = materialize(spark, places(spark, by_rarity(spark, windows, terms, postings), postings), "matches")
    hit = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = found.select("row", "window").distinct().join(if_small(items, MAX_BROADCAST), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("found"))
    rows = postings.where("term IS NULL").select("row", F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("n_words")).join(hit, "row", "left").join(listed, "row", "left")
    own = F.coalesce("found", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(own, ",").cast("binary"), 256).alias("items_sha256"), (F.size(own) >= 2).alias("contaminated"),
    )


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[s:s + 7], ' ') AS t, least(8, len(w)) AS n FROM bs),
lens AS (SELECT DISTINCT n FROM win),
ds AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
hit AS (SELECT ds.r, ds.s, win.n, win.item FROM ds JOIN win ON win.n = ds.n AND win.t = array_to_string(w[s:s + ds.n - 1], ' ')),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos ON pos.r = d.r LEFT JOIN it ON it.r = d.r
"""
