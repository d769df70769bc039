"""Connected components and decaying walks over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import discard, materialize


def connected_components(spark: SparkSession, edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of each node of edges(u, v), root the smallest node of its component.

    Alternating large-star and small-star steps: a round ends in a written table, the number of rounds grows
    with the logarithm of the component's size, and every group is reduced to its minimum before rows meet.
    It ends once the links are stars around their smallest nodes, which one aggregate tells; no link reaches the driver.
    """
    now = materialize(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    side = lambda c, below: now.select(F.col(c).alias("x"), F.lit(below).alias("below"), F.lit(1 - below).alias("above"))
    for _ in range(rounds):
        ends = side("u", 1).unionByName(side("v", 0)).groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not ends.where("below > 1 OR below = 1 AND above = 1").limit(1).count():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("r"))
        pair = F.array(F.struct("u", F.col("r").alias("v")), F.struct(F.col("v").alias("u"), F.col("r").alias("v")))
        small = large.join(root, "u").select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        former, now = now, materialize(spark, small, name)
        discard(spark, former)
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def decayed_walk(spark: SparkSession, seeds: DataFrame, edges: DataFrame, decay: float, least: float = 1.0) -> DataFrame:
    """(seed, node, weight): the largest weight at which each node is reached from seeds(seed, node, weight).

    A step passes (1 - decay) * weight, shared over all neighbours in edges(a, b), both directions being given; weights
    below `least` stop. As weights shrink by each step, the number of steps is bounded by the largest seed's weight.
    """
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    steps = edges.join(degree, "a").select("a", "b", (F.lit(1 - decay) / F.col("n")).alias("share"))
    front = seeds.select("seed", "node", F.col("weight").cast("double").alias("weight")).where(F.col("weight") >= least)
    top = front.agg(F.max("weight")).first()[0] or 0.0
    reached = front
    while top * (1 - decay) >= least:
        front = front.join(steps, front.node == steps.a).select("seed", F.col("b").alias("node"), (F.col("weight") * F.col("share")).alias("weight")).where(F.col("weight") >= least)
        front = materialize(spark, front.groupBy("seed", "node").agg(F.max("weight").alias("weight")), "walk-front")  # the next step and the result read it
        reached = reached.unionByName(front)
        top *= 1 - decay
    return reached.groupBy("seed", "node").agg(F.max("weight").alias("weight"))
