"""Session settings and the few helpers that touch the running session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(app: str = "tintwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `master` and memory are left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder the cluster names. Only a local session may go without: its executors are the driver."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", "")
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if not shared and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tintwell-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for loops, so a lost executor does not replay every earlier step."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def constant_rows(df: DataFrame, max_rows: int = 4096) -> Column:
    """A small dimension as one constant array of structs, for use inside expressions.

    The dimension is counted first: larger ones are refused, as they belong in a join.
    """
    rows = df.limit(max_rows + 1).toJSON().collect()
    if len(rows) > max_rows:
        raise ValueError(f"a constant table may hold {max_rows} rows at most")
    return F.from_json(F.lit("[" + ",".join(rows) + "]"), f"array<{df.schema.simpleString()}>")


def spread(df: DataFrame) -> DataFrame:
    """Gives a scan that yields fewer splits than there are cores an even start.

    One small file is one task, however costly the rows are to compute. Real
    tables have more splits than cores and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
