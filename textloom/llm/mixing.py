"""Mixing sources to target weights, by hash-threshold histograms.

A document's place is the MD5 of its id, or of its text if it has none. Each source takes whole copies of all its documents and then, for what is left
of its target, the documents below a threshold. The threshold is found without sorting: sizes are summed by source and
leading hash digits, the digits at which the budget runs out are the boundary bucket, and only that bucket is refined by
further digits. What stands at the boundary doesn't fit and is passed over, and the rest of the budget is spent behind it
by the same search (nested budgets), so that one long document doesn't leave a source short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import discard, materialize, quoted

WORD = "[^\\x20\\x09-\\x0D]+"
#: Hash digits per refinement, refinements per search, searches per source; sources whose thresholds may be broadcast.
DIGITS, LEVELS, PASSES, MAX_BROADCAST = 4, 2, 4, 100_000
WEIGHTS, MAX_COPIES = (5, 2, 1), 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def target_sizes(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """by_source(k, source, source_size) with the column target.

    Weights repeat over the sources in order (nulls last); targets share all sizes by weight and stop at `most` times the
    source's size. Sharing the excess again and again ends where every source below its stop gets level * weight; with
    sources sorted by the level at which they stop, that level is the largest of what is left over the weights left.
    One row per source goes through these windows, in one task: right for some ten million sources, not for more.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("w", w).withColumn("stop", F.lit(most) * F.col("source_size"))
    up = W.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    down = W.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(up), F.lit(0))) / F.sum("w").over(down)
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("k", "source", "source_size", F.least(F.col("stop").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of each row; taken is a multiple of size, at most `most` times it.

    Size is the number of words, 0 for null text; such rows have taken 0. A null source is a source of its own. Rows
    that repeat an id, or a text without id, share a place and are taken or left together. The result depends on the rows alone, so reruns
    agree; an empty table gives an empty one, and other columns, whatever their names, aren't read. A hot source is summed within tasks first; rows meet a table of one row per source, which is broadcast only
    if a count shows it small.
    """
    own = F.when(quoted(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("_"), quoted(source)))
    told = F.coalesce(quoted(doc_id).cast("string"), F.concat(F.lit(" "), quoted(text)), F.lit(""))
    place = F.substring(F.md5(told.cast("binary")), 1, DIGITS * LEVELS)
    rows = materialize(spark, docs.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), own.alias("k"), word_count(quoted(text)).alias("size"), place.alias("place")), "sizes")
    by_source = rows.groupBy("k").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    targets = materialize(spark, target_sizes(by_source, weights, most), "targets")
    small = targets.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    per_source = lambda df: F.broadcast(df) if small else df

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("copies", whole).withColumn("left_0", F.floor(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")).withColumn("from_0", F.lit(""))
    for p in range(PASSES):
        state = plan.select("k", F.col(f"from_{p}").alias("start"), F.col(f"left_{p}").alias("fits"), F.col(f"left_{p}").alias("budget"), F.lit("").alias("prefix"))
        for n in range(1, LEVELS + 1):
            inside = rows.join(per_source(state), "k").where("size > 0 AND size <= fits AND place > start").where(F.substring("place", 1, DIGITS * (n - 1)) == F.col("prefix"))
            sums = inside.groupBy("k", F.substring("place", 1, DIGITS * n).alias("bucket")).agg(F.sum("size").alias("words"), *(F.max(c).alias(c) for c in ("budget", "start", "fits")))
            so_far = F.sum("words").over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
            over = sums.withColumn("rest", F.col("budget") - (so_far - F.col("words"))).where("rest < words")
            state = over.groupBy("k").agg(F.min(F.struct("bucket", "rest", "start", "fits")).alias("e")).select("k", F.col("e.start").alias("start"), F.col("e.fits").alias("fits"), F.col("e.rest").alias("budget"), F.col("e.bucket").alias("prefix"))
        found = state.select("k", F.col("prefix").alias("to"), F.col("budget").alias("rest"))
        # a source without a boundary has taken all that can fit: nothing is left for a later search
        plan = plan.join(per_source(found), "k", "left").withColumn(f"from_{p + 1}", F.coalesce("to", F.lit("g"))).withColumn(f"left_{p + 1}", F.coalesce("rest", F.lit(0).cast("long"))).drop("to", "rest")
        former, plan = plan, materialize(spark, plan, "thresholds")
        discard(spark, former)
    chosen = F.lit(False)
    for p in range(PASSES):
        chosen = chosen | ((F.col("size") <= F.col(f"left_{p}")) & (F.col("place") > F.col(f"from_{p}")) & (F.col("place") < F.col(f"from_{p + 1}")))
    taken = F.col("size") * (F.col("copies") + F.when(chosen, 1).otherwise(0))
    return rows.join(per_source(plan.drop("source")), "k").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def oracle_sql() -> str:
    """The same rows by sorting, for DuckDB."""
    passes = ""
    for p in range(PASSES):
        passes += f""",
c{p} AS (SELECT r.k, place, sum(size) AS words FROM r JOIN p{p} USING (k) WHERE size > 0 AND size <= left_{p} AND place > from_{p} GROUP BY r.k, place),
s{p} AS (SELECT *, sum(words) OVER (PARTITION BY k ORDER BY place) AS so_far FROM c{p}),
e{p} AS (SELECT s.k, min(CASE WHEN so_far > left_{p} THEN place END) AS edge,
  sum(CASE WHEN so_far <= left_{p} THEN words ELSE 0 END) AS used FROM s{p} s JOIN p{p} USING (k) GROUP BY s.k),
p{p + 1} AS (SELECT p.*, coalesce(e.edge, 'g') AS from_{p + 1}, CASE WHEN e.k IS NULL THEN 0 ELSE left_{p} - e.used END AS left_{p + 1} FROM p{p} p LEFT JOIN e{p} e ON e.k = p.k)"""
    chosen = " OR ".join(f"(size <= left_{p} AND place > from_{p} AND place < from_{p + 1})" for p in range(PASSES))
    return f"""
WITH r AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '_' || source END AS k,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), ' ' || text, '')), 1, {DIGITS * LEVELS}) AS place FROM documents),
b AS (SELECT k, max(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS stop FROM b),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT k, source_size, least(CAST(stop AS DOUBLE), max(level) OVER () * w) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
p0 AS (SELECT *, CAST(floor(target - copies * source_size) AS BIGINT) AS left_0, '' AS from_0 FROM q){passes}
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN {chosen} THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN p{PASSES} USING (k)
"""
