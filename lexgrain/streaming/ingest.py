"""Incremental ingestion and thread memory on Structured Streaming."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.session import shared_folder
from lexgrain.sources import store_files
from lexgrain.sources.tables import latest


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A table's files as a stream, a few files to a batch; the table may be a file or a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{name}.parquet").select("path").first()[0]
    if at.endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def ingest(stream: DataFrame, root: str, key: str, updates: list[str], by: str, checkpoint: str, buckets: int = 64) -> None:
    """Upserts every batch into a bucketed table; deterministic keys make a replayed batch harmless."""

    def one(batch: DataFrame, _: int) -> None:
        store_files.merge(batch.sparkSession, root, latest(batch, [key], by), key, updates, buckets)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def thread_memory(stream: DataFrame, thread: str, time: str, value: str, keep: int = 6, idle: str | None = None) -> DataFrame:
    """``thread, turns, oldest, newest`` after every batch: the last ``keep`` turns of each thread as keyed state.

    idle: how long the event time may pass a thread's last turn (as "30 minutes") before its state is dropped; the stream then needs
    a watermark on ``time``. How many threads are held is bounded over all keys by ``conversation.recent_threads`` on the result.
    """
    wait = None if idle is None else pd.Timedelta(idle)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        last = 0
        for f in frames:
            held += [f"{int(t.timestamp() * 1e6):020d}|{v}" for t, v in zip(f["time"], f["value"])]
        held = sorted(held)[-keep:]
        state.update((held,))
        if wait is not None:
            last = int(held[-1].split("|", 1)[0]) // 1000 + int(wait.total_seconds() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"thread": [key[0]], "turns": [len(held)], "oldest": [held[0].split("|", 1)[1]], "newest": [held[-1].split("|", 1)[1]]})

    some = stream.where(F.col(thread).isNotNull()).select(F.col(thread).cast("string").alias("thread"), F.col(time).alias("time"), F.col(value).cast("string").alias("value"))
    return some.groupBy("thread").applyInPandasWithState(step, "thread string, turns int, oldest string, newest string", "held array<string>", "update", "NoTimeout" if wait is None else "EventTimeTimeout")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is, each batch a folder, and reads all of it with ``batch`` added."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def one(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/data/b={i}")

    stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("b")
