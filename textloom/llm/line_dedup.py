"""Line deduplication over overlapping three-line windows.

Every three consecutive non-blank lines of a document are one window, named by hashes of its lines. A window's first
occurrence, by document id and position, stays; the lines that later occurrences cover are removed, overlaps merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, quoted, unused

WINDOW = 3


def repeated_windows(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, own, lines): for each later occurrence of a window, the document's key and the indices of its lines.

    The windows are written once; counting them and finding their later occurrences both read that table. Windows are
    reduced to their first occurrence within tasks before they meet, and only repeated ones are joined back, on the
    windows' side of a join that Spark may split. Windows are told apart by 96 bits of two hashes and aren't compared line
    by line: among 10^12 different ones the chance that any two agree is under 10^-4.
    """
    words = F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda s: s["x"] != "")
    rows = docs.select(quoted(doc_id).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("t")).select("id", F.xxhash64("t").alias("own"), words.alias("l"))
    at = lambda k, j: F.col("l")[k + j]
    window = lambda k: F.struct(
        F.xxhash64(*[at(k, j)["x"] for j in range(WINDOW)]).alias("h1"), F.hash(*[at(k, j)["x"] for j in range(WINDOW)], F.lit(7)).alias("h2"), F.array(*[at(k, j)["i"] for j in range(WINDOW)]).alias("lines")
    )
    found = rows.where(F.size("l") >= WINDOW).select("id", "own", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), window)).alias("w")).select("id", "own", "w.h1", "w.h2", "w.lines")
    windows = materialize(spark, found, "line-windows")
    place = F.struct("id", "own", "lines")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("id", "own", "lines")


def dedup_lines(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the column `text` replaced, and two counts added under the given names: all lines, blank ones too, and removed lines.

    Blank lines are in no window and always stay. Documents of fewer than three non-blank lines, null and empty texts are
    left as they are (a null text has no lines). Rows that repeat both id and text are one document and get the same
    result; null ids come first in order; an empty table gives an empty one. Of other columns, those with the names of the
    counts are replaced; all others, whatever their names, are passed on.
    """
    n_lines, n_removed = counts
    id_, own_, drop_ = unused(docs, "id", "own", "drop")
    drop = repeated_windows(spark, docs, text, doc_id).groupBy("id", "own").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("drop"))
    drop = drop.select(F.col("id").alias(id_), F.col("own").alias(own_), F.col("drop").alias(drop_))
    body, gone = quoted(text), F.col(drop_)
    joined = docs.join(drop, quoted(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col(own_)), "left")
    lines = F.split(body, "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")
    cut = F.when(gone.isNull(), body).otherwise(left).alias(text)
    others = [cut if c == text else quoted(c) for c in docs.columns if c.lower() not in (n_lines.lower(), n_removed.lower())]
    return joined.select(*others, F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias(n_removed))


ORACLE_SQL = """
WITH r AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM r),
u AS (SELECT doc_id, text, unnest(l) AS x, unnest(range(len(l))) AS i FROM s),
n AS (SELECT doc_id, text, trim(x, ' ') AS x, i FROM u WHERE trim(x, ' ') <> ''),
w AS (SELECT doc_id, text, i, lead(i) OVER o AS i1, lead(i, 2) OVER o AS i2, x, lead(x) OVER o AS x1, lead(x, 2) OVER o AS x2 FROM n
  WINDOW o AS (PARTITION BY doc_id, text ORDER BY i)),
k AS (SELECT *, row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, i) AS nth FROM w WHERE i2 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, text, unnest([i, i1, i2]) AS i FROM k WHERE nth > 1),
o AS (SELECT u.doc_id, u.text, count(*) AS n_lines, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN u.x END, chr(10) ORDER BY u.i) AS kept
  FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.text = u.text AND c.i = u.i GROUP BY u.doc_id, u.text)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.kept, '') END AS text
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id AND o.text = d.text
"""
