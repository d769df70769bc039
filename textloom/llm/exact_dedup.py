"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is its 64-bit hash, whose leading bits name an entry of the directory. The directory doubles until no
bucket holds more keys than it may, or its keys can't be told apart; several entries may share a bucket. Rows of hash,
id and text go to the bucket's owner task, which has whole buckets, that is ranges of keys: there equal hashes are
chained and texts compared byte by byte, and one entry per text goes to the index files, sorted by bucket and hash.
Hashes of very many rows are few; their rows are counted within the input tasks before they meet, so that no owner gets
a hot text's copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, if_small, materialize, quoted

#: Keys a bucket may hold at least, buckets up to which more keys make more buckets, and bits that the directory may use.
CAPACITY, BUCKETS, MAX_DEPTH = 1 << 13, 1 << 18, 24
#: Rows from which a hash is hot; more on larger tables, so that there are never more than MAX_HOT hot hashes.
HOT, MAX_HOT = 1000, 50_000


def leading(h: Column, depth) -> Column:
    """The first depth bits of a 64-bit hash (Spark's shiftrightunsigned of a shift by 64 would keep all bits)."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (F.lit(64) - d).cast("int")))


def directory(spark: SparkSession, keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(depth, prefix): the buckets. keys(h): one row per distinct key.

    A round counts the keys of the buckets that are still open at this depth and closes those that fit; overfull ones
    are split by the next bit. Counting starts from a histogram over max_depth bits, so a round reads small tables.
    """
    fine = materialize(spark, keys.groupBy(leading(F.col("h"), max_depth).alias("p")).agg(F.count(F.lit(1)).alias("n")), "histogram")
    total = fine.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = 0
    while least < max_depth and total > capacity << least:  # depths at which some bucket must be overfull
        least += 1
    at = lambda d: F.shiftright(F.col("p"), max_depth - d)
    leaf, open_rows, histograms = None, fine, [fine]
    for d in range(least, max_depth + 1):
        counts = open_rows.groupBy(at(d).alias("prefix")).agg(F.sum("n").alias("n"))
        fits = counts.where(F.col("n") <= capacity) if d < max_depth else counts
        closed = fits.select(F.lit(d).alias("depth"), "prefix")
        leaf = closed if leaf is None else leaf.unionByName(closed)
        if d == max_depth or not counts.where(F.col("n") > capacity).limit(1).count():
            break
        over = counts.where(F.col("n") > capacity).select(F.col("prefix").alias("q"))
        open_rows = materialize(spark, open_rows.join(over, at(d) == F.col("q"), "left_semi"), "histogram")
        histograms.append(open_rows)
    buckets = materialize(spark, leaf, "directory")
    discard(spark, *histograms)
    return buckets


def in_bucket(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """keyed(h, ..) with the bucket ('depth-prefix') that its leading bits lead to, by one lookup in the doubled directory.

    The directory has 2^depth entries for its greatest depth; a bucket of a smaller depth is shared by several. Rows whose
    entry is missing are lost, as nobody owns them.
    """
    depth = buckets.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    spare = F.lit(depth) - F.col("depth")
    first = F.call_function("shiftleft", F.col("prefix"), spare)
    entries = buckets.select(F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), spare) - 1)).alias("entry"), F.concat_ws("-", "depth", "prefix").alias("bucket"))
    return keyed.withColumn("entry", leading(F.col("h"), depth)).join(if_small(entries, 2 * BUCKETS), "entry").drop("entry")


def build_index(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hot: int = HOT, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The index (bucket, h, text_sha256, keep_id, group_size) on shared files, and its directory; one entry per distinct text.

    Two passes over the texts: the first counts hashes, from which the directory and the hot hashes come; the second
    sends each row's hash, id and text to its bucket's owner.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    counts = materialize(spark, rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "hash-counts")
    keys, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = directory(spark, counts.select("h"), max(capacity, keys // BUCKETS), max_depth)
    often = F.broadcast(counts.where(F.col("n") > max(hot, total // MAX_HOT)).select("h"))  # at most MAX_HOT rows: their counts add up to the total
    group = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # dealt by bucket already, so this aggregate needs no exchange: the owner chains equal hashes and compares texts
    owned = in_bucket(rows.join(often, "h", "left_anti"), buckets).repartition("bucket").groupBy("bucket", "h", "text").agg(*group)
    copies = in_bucket(rows.join(often, "h", "left_semi").groupBy("h", "text").agg(*group), buckets)
    entry = ["bucket", "h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"]
    index = materialize(spark, owned.select(*entry).unionByName(copies.select(*entry)).sortWithinPartitions("bucket", "h"), "hash-index")
    discard(spark, counts)
    return index, buckets


def exact_duplicates(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hot: int = HOT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id of a group stays. Repeated rows
    with that same id all stay (nothing tells them apart); a group whose ids are all null has a null keep_id and keeps
    its rows. Empty tables give an empty result; other columns aren't read. Rows find their entry by bucket, hash and
    digest, in a join that Spark may split on the rows' side.
    """
    index, buckets = build_index(spark, docs, capacity, max_depth, hot, text, doc_id)
    body = F.coalesce(quoted(text), F.lit(""))
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.xxhash64(body).alias("h"), F.sha2(body.cast("binary"), 256).alias("text_sha256"))
    found = in_bucket(rows, buckets).join(index, ["bucket", "h", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
