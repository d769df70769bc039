"""Helpers shared by the training-data operators: tables, shared storage and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is set and Spark runs in one process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    fs, hadoop = _files(spark, path)
    fs.deleteOnExit(hadoop)  # no table outlives the application
    return out


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def discard(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_textloom_path", None):
            fs, hadoop = _files(spark, path)
            fs.delete(hadoop, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, marked for broadcast if a count of it (a written table of narrow rows) stays within that number of rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text leaves 1 by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. All-ASCII rows take the fast path; others are translated, so that É stays É."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def connected_components(spark: SparkSession, edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of each node of edges(u, v), root the smallest node of its component.

    Alternating large-star and small-star steps: a round ends in a written table, the number of rounds grows
    with the logarithm of the component's size, and every group is reduced to its minimum before rows meet. It ends
    once the links are stars around their smallest nodes, which one aggregate tells; no link reaches the driver.
    """
    now = materialize(
        spark,
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        name,
    )
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if not ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below = 1 AND above = 1").limit(1).count():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("r"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct("u", F.col("r").alias("v")), F.struct(F.col("v").alias("u"), F.col("r").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        following = materialize(spark, small, name)
        discard(spark, now)
        now = following
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
