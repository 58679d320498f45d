"""Shared helpers: tables, intermediate results in the shared folder, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by `spark.checkpoint.dir`.

    Only a local session, whose executors are the driver, may go without: it gets a temporary folder for its lifetime.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tintwell-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes the rows to the shared folder and reads them again.

    This cuts the lineage, survives lost executors, and lets Catalyst see the true size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 512):
    """Cuts the batches of a task into smaller ones and lets go of each batch before the next is read.

    Workers live on between tasks, so what a batch took also goes back to the system.
    """
    source = iter(batches)
    while (batch := next(source, None)) is not None:
        for at in range(0, len(batch), rows):
            # A copy, as a view would keep the whole batch for as long as its last rows are in use.
            yield batch.iloc[at : at + rows].copy()
        del batch
        give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its smallest node.

    Alternating large-star and small-star rounds. Each round aggregates a minimum per node, which combines before the
    shuffle, and joins it back, which adaptive execution can split, so a hub with a third of all edges is no single task.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(e: DataFrame) -> bool:
    """Every upper end has one edge, and no lower end is an upper end."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low"))
    ends = ends.unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up + low > 1").isEmpty()
