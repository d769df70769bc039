"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and Spark runs in one process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    fs, hadoop = _files(spark, path)
    fs.deleteOnExit(hadoop)  # no table outlives the application
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all cores if by the optimizer's estimate it is too small to fill their read partitions, else as it is. Nothing runs."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    each = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *by) if size < cores * each else df


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def discard(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_textloom_path", None):
            fs, hadoop = _files(spark, path)
            fs.delete(hadoop, True)
