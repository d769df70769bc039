"""A corpus from documents: quality, repeated lines, near duplicates, benchmark passages, and a mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet to the shared
folder and gives them to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm import decontaminate, line_dedup, mixing, quality
from textloom.llm.common import discard, materialize, quoted, table, unused
from textloom.llm.simhash import near_duplicates


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject (score of 0.5 or more).

    Null and empty texts are scored like any other; repeated rows are kept or go together; without labels all rows stay.
    An empty table gives an empty one, and columns of any other names are passed on.
    """
    return quality.good_rows(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; so do documents of which nothing but white space is left.

    n_chars is counted anew where lines went. Null texts and those of fewer than three lines stay; rows that repeat id and
    text are one document. An empty table gives an empty one, and columns of any other names are passed on.
    """
    n_lines, n_removed = unused(docs, "n_lines", "n_removed")
    cut = line_dedup.dedup_lines(spark, docs, counts=(n_lines, n_removed))
    changed = F.col(n_removed) > 0
    left = cut.where(~changed | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    counted = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*[counted if c == "n_chars" else quoted(c) for c in docs.columns])


def own_key(docs: DataFrame) -> Column:
    """What tells rows apart: the id and a hash of the text, null ids and texts included."""
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("own"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest id stays.

    Rows are told apart by id and text; of rows that repeat both, one stays. Texts without words, null ones included, are
    one group. An empty table gives an empty one, and columns of any other names are passed on.
    """
    id_, own_ = unused(docs, "id", "own")
    groups = materialize(spark, near_duplicates(spark, docs.select(own_key(docs).alias("row_id"), "text"), shingle=5, similarity=0.8), "near-groups")
    kept = groups.where("row_id <=> component").groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = kept.where("n > 1").limit(1).count()
    kept = kept.select(F.col("row_id.doc_id").alias(id_), F.col("row_id.own").alias(own_))
    one = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_)), "left_semi")
    return one.dropDuplicates(["doc_id", "text"]) if repeated else one


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of any benchmark item go; a full window of eight words is enough.

    Null texts have no words and stay; repeated rows stay or go together. An empty table, of documents or items, gives its
    rows back, and columns of any other names are passed on.
    """
    id_, own_ = unused(docs, "id", "own")
    found = decontaminate.phrase_matches(spark, docs.select(own_key(docs).alias("key"), "text"), table(spark, sf_dir, "benchmark"), doc_id="key")
    bad = found.where("start IS NOT NULL").select(F.col("id.doc_id").alias(id_), F.col("id.own").alias(own_)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with the number of copies and of words.

    The two columns are named `copies` and `words`, with underscores added where docs has such names. Null and wordless
    texts have no words and aren't taken; a null source is one of its own; rows that repeat id and text are taken together.
    An empty table gives an empty one, and columns of any other names are passed on.
    """
    key_, copies_, words_ = unused(docs, "key", "copies", "words")
    rows = docs.select(own_key(docs).alias("key"), "text", "source")
    taken = mixing.mix(spark, rows, doc_id="key").where("taken > 0").groupBy(F.col("doc_id").alias(key_)).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(copies_), F.max("taken").alias(words_))
    id_, own_ = F.col(f"{key_}.doc_id"), F.col(f"{key_}.own")
    return docs.join(taken, docs["doc_id"].eqNullSafe(id_) & (F.xxhash64(F.coalesce("text", F.lit(""))) == own_)).drop(key_)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("mix", mix_sources),
]

#: The classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        former, docs = docs, materialize(spark, stage(spark, docs, sf_dir), name)
        discard(spark, former)
    return docs
