"""Runs a stream over what has arrived so far and hands back the written result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

from tintwell.session import ensure_checkpoint_dir


#: Keeps state on local disk with a changelog in the checkpoint folder; typed state variables need it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """File stream of one table; new files of the same name pattern join it as they land."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", 8).parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes the available input into files under the shared checkpoint folder and reads them.

    Append results are exactly-once files. Update results are written batch by
    batch with their batch number, so a reader can keep the newest row of a key.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:

        def write(batch: DataFrame, number: int) -> None:
            # Overwriting the batch's own folder keeps a retried batch from counting twice.
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.foreachBatch(write).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(out)
