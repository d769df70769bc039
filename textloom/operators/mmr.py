"""Maximal marginal relevance and greedy de-duplication, of a group's candidates.

For relevance a group is one question's candidates, folded in one row: the state holds the picks, and for each candidate its
largest similarity to a pick. De-duplication takes groups of any size, block by block.
"""

from __future__ import annotations

import functools
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import Diversity
from ..functions.similarity import dot, let, norm
from .storage import discard, materialize


def _unit(v: Column) -> Column:
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") / n)))


def mmr(rows: DataFrame, config: Diversity = Diversity(), group: str = "question_id", item: str = "item", order: str = "pos") -> DataFrame:
    """(group, item, step) of the picks from rows(group, item, order, text, vec, query_vec).

    Each step takes the candidate with the largest score, the first on ties: balance * similarity to the query, less
    (1 - balance) * largest similarity to a pick; 0 if that reaches `duplicate`. A candidate whose text was picked already
    is removed without counting as a pick. A group of fewer candidates than wanted is returned whole, in its order. A number
    of sentences that is a float is a share of the group's candidates.
    """
    lam = config.balance
    one = let(_unit(F.col("vec")), lambda v: F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.col("text").alias("t"), v.alias("v"), F.round(let(_unit(F.col("query_vec")), lambda q: dot(v, q)), 12).alias("q")))
    groups = rows.groupBy(group).agg(F.array_sort(F.collect_list(one)).alias("c"))
    c = F.col("c")
    n = F.floor(F.size(c) * F.lit(config.sentences)).cast("int") if isinstance(config.sentences, float) else F.lit(config.sentences)
    start = F.struct(F.array().cast("array<int>").alias("picked"), F.array().cast("array<int>").alias("gone"), F.transform(c, lambda x: F.lit(-2.0)).alias("mx"))

    def score(s, x, i):
        fresh = F.when(F.size(s["picked"]) == 0, lam * x["q"]).when(F.get(s["mx"], i) >= config.duplicate, 0.0).otherwise(lam * x["q"] - (1 - lam) * F.get(s["mx"], i))
        return F.when(F.array_contains(s["gone"], i), F.lit(-1e9)).otherwise(F.round(fresh, 9))

    def step(s, _):
        def take(best):
            chosen = F.get(c, best)
            repeated = F.exists(s["picked"], lambda p: F.get(c, p)["t"] == chosen["t"])
            grown = F.struct(F.concat(s["picked"], F.array(best)).alias("picked"), F.concat(s["gone"], F.array(best)).alias("gone"), F.transform(c, lambda x, i: F.greatest(F.get(s["mx"], i), F.round(dot(x["v"], chosen["v"]), 12))).alias("mx"))
            skipped = F.struct(s["picked"].alias("picked"), F.concat(s["gone"], F.array(best)).alias("gone"), s["mx"].alias("mx"))
            return F.when(repeated, skipped).otherwise(grown)

        done = (F.size(s["picked"]) >= n) | (F.size(s["gone"]) >= F.size(c))
        scores = F.transform(c, lambda x, i: score(s, x, i))
        best = let(scores, lambda sc: (F.array_position(sc, F.array_max(sc)) - 1).cast("int"))
        return F.when(done, s).otherwise(let(best, take))

    whole = F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: i.cast("int"))
    fold = F.aggregate(F.sequence(F.lit(1), F.size(c)), start, step)
    picked = F.when(F.size(c) < n, whole).otherwise(fold["picked"])
    # the outer form here and below, lest a filter on the fold's size be inferred and run it twice
    found = groups.select(group, F.posexplode_outer(F.transform(picked, lambda i: F.get(c, i)["i"])).alias("step", item))
    return found.where("step IS NOT NULL").withColumn("step", F.col("step") + 1)


#: Vectors that are told apart in one task at a time.
BLOCK = 4096


def _near(a: np.ndarray, b: np.ndarray, duplicate: float) -> np.ndarray:
    """Whether rows of a and b have a product, rounded to 12 digits, of `duplicate` or more; NaN counts as more, as in Spark.

    Products within 1e-9 of the bound are added up once more in the order of the elements.
    """
    out = np.zeros((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), 512):
        s = a[at : at + 512] @ b.T
        out[at : at + 512] = ~(s < duplicate)
        for i, j in zip(*np.nonzero(np.abs(s - duplicate) < 1e-9)):
            exact = functools.reduce(lambda t, x: t + x, (a[at + i] * b[j]).tolist(), 0.0)
            out[at + i, j] = float(Decimal(repr(exact)).quantize(Decimal("1e-12"), ROUND_HALF_UP)) >= duplicate
    return out


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype="float64").reshape(rows, -1)


def greedy_dedupe(rows: DataFrame, duplicate: float = 0.9, group: str = "question_id", item: str = "item", order: str = "pos") -> DataFrame:
    """(group, item) kept from rows(group, item, order, vec): in order, those below `duplicate` similarity to every kept one.

    All pairs of a group may have to be compared. A round takes the next BLOCK vectors of every group: each kept block is
    compared with them in a task of its own, then what is left is decided in order. Vectors of other lengths, and those
    with nulls, are similar to none.
    """
    spark = rows.sparkSession
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    keyed = rows.select(F.col(group).alias("k"), F.col(item).alias("i"), F.col(order).alias("o"), _unit(F.col("vec")).alias("v"), F.coalesce(whole, F.lit(False)).alias("whole")).withColumn("g", F.to_json(F.struct("k", F.size("v").alias("d"))))
    place = F.row_number().over(W.partitionBy("whole", "g").orderBy("o", "i", "v"))
    ranked = materialize(spark, keyed.withColumn("place", place).drop("o"), "vectors")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        places, vectors = part["place"].to_numpy("int64"), np.stack(part["v"].to_numpy()).astype("float64")
        return pd.DataFrame({"g": [part["g"].iloc[0]], "block": [int(part["block"].iloc[0])], "places": [places.tobytes()], "vectors": [vectors.tobytes()]})

    shape = "g string, block int, places binary, vectors binary"
    whole_rows = ranked.where("whole").select("g", "place", "v", ((F.col("place") - 1) / BLOCK).cast("int").alias("block"))
    packed = materialize(spark, whole_rows.groupBy("g", "block").applyInPandas(pack, shape), "vector-blocks", ["block"])
    blocks = packed.select("g", "block", "places", "vectors")

    def compare(batches):
        for batch in batches:
            for x in batch.itertuples():
                a, b = (_matrix(v, len(p) // 8) for v, p in ((x.vectors, x.places), (x.kept_vectors, x.kept_places)))
                yield pd.DataFrame({"g": [x.g], "gone": [_near(a, b, duplicate).any(axis=1).tobytes()]})

    def decide(batches):
        for batch in batches:
            for x in batch.itertuples():
                places = np.frombuffer(x.places, dtype="int64")
                left = np.ones(len(places), dtype=bool)
                for gone in () if x.gone is None else x.gone:
                    left &= ~np.frombuffer(gone, dtype=bool)
                places, vectors = places[left], _matrix(x.vectors, len(left))[left]
                near, kept = _near(vectors, vectors, duplicate), np.zeros(len(places), dtype=bool)
                for n in range(len(places)):
                    kept[n] = not (near[n, :n] & kept[:n]).any()
                yield pd.DataFrame({"g": [x.g], "block": [x.block], "places": [places[kept].tobytes()], "vectors": [vectors[kept].tobytes()]})

    last = blocks.agg(F.max("block")).first()[0]
    done: list[DataFrame] = []
    read = lambda: spark.read.schema(shape).parquet(*[t._textloom_path for t in done])
    for n in range(0 if last is None else last + 1):
        now = blocks.where(F.col("block") == n)
        if n:
            kept = read().where("length(places) > 0").select("g", F.col("block").alias("at"), F.col("places").alias("kept_places"), F.col("vectors").alias("kept_vectors"))
            pairs = now.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(kept, ["g", "at"]).repartition("g", "at")
            gone = pairs.mapInPandas(compare, "g string, gone binary").groupBy("g").agg(F.collect_list("gone").alias("gone"))
            now = now.join(gone, "g", "left")
        else:
            now = now.withColumn("gone", F.lit(None).cast("array<binary>"))
        done.append(materialize(spark, now.mapInPandas(decide, shape), "vectors-kept"))
    discard(spark, packed)
    single = ranked.where("NOT whole").select(F.col("k").alias(group), F.col("i").alias(item))
    if not done:
        return single

    def unpack(batches):
        for batch in batches:
            for x in batch.itertuples():
                yield pd.DataFrame({"g": x.g, "place": np.frombuffer(x.places, dtype="int64").astype("int32")})

    found = read().select("g", "places").where("length(places) > 0").mapInPandas(unpack, "g string, place int")
    return ranked.where("whole").join(found, ["g", "place"], "left_semi").select(F.col("k").alias(group), F.col("i").alias(item)).unionByName(single)
