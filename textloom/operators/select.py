"""Selection of sentences: top-k per answer, gap filling, positions, post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import Selection
from ..functions import text as T
from .corpus import KEY


def top_sentences(rows: DataFrame, config: Selection = Selection(), score: str = "score") -> DataFrame:
    """rows(keys, tokens, score) with rank and chosen.

    By descending score, ties in sentence order; k is the limit (num), that share of the sentences (ratio) or the number of
    leading scores that reach it (threshold), at least 1, and ranks 0..k are chosen. Sentences of fewer than two tokens are
    passed over afterwards and not replaced.
    """
    w = W.partitionBy(*KEY[:2])
    s = F.round(score, 9)
    n = F.count(F.lit(1)).over(w)
    if config.kind == "ratio":
        k = F.floor(n * F.lit(float(config.limit)))
    elif config.kind == "threshold":
        k = F.sum(F.when(s >= config.limit, 1).otherwise(0)).over(w)
    else:
        k = F.least(F.lit(int(config.limit)), n)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(s.desc(), "sentence_id"))).withColumn("k", F.greatest(k, F.lit(1)))
    return ranked.withColumn("chosen", (F.col("rank") <= F.col("k") + 1) & (F.size("tokens") >= 2)).drop("k")


def fill_gaps(rows: DataFrame, reach: int = 3) -> DataFrame:
    """The rows(keys, chosen) that stay: chosen ones, and those between chosen ones no more than `reach` apart.

    A first chosen sentence with a number up to `reach` draws in all before it.
    """
    w = W.partitionBy(*KEY[:2]).orderBy("sentence_id")
    own = F.when(F.col("chosen"), F.col("sentence_id"))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return rows.withColumn("_b", before).withColumn("_a", after).where((F.coalesce(F.col("_a") - F.col("_b"), F.lit(reach + 1)) <= reach) | (F.coalesce("_a", F.lit(reach + 1)) <= reach)).drop("_a", "_b")


def post_process(rows: DataFrame, order: list[str]) -> DataFrame:
    """(question_id, summary): sentences in order without questions, examples, urls, entity lists and single words; [...] cut out."""
    keep = rows.where(~F.col("sentence").contains("?") & ~F.col("sentence").contains("example") & (F.size("ners") < 25) & (F.size("tokens") > 1) & ~T.has_url(F.col("sentence")))
    listed = F.array_sort(F.collect_list(F.struct(*order, "sentence")))
    return keep.groupBy("question_id").agg(T.strip_brackets(F.array_join(F.transform(listed, lambda s: s["sentence"]), " ")).alias("summary"))
