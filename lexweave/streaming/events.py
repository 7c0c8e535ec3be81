"""Streams of events: windows over late data, sessions, duplicates and appended labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.jsonl import shared_folder

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and sum per window and event type; events later than `late` are dropped by a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without those sent again within `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Per user the sessions between gaps: start, end (the last event's time plus the gap) and events."""
    s = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives over all that is there now, read back from the shared folder.

    In complete mode each batch replaces the table; the last stands. State and offsets are in the shared folder.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/table")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Appends what a stream brings to a table, leaving out keys that are in it: a run that stopped goes on where it was."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(path).select(key)
            batch = batch.join(done, key, "left_anti")
        except Exception as e:  # there is no table before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.dropDuplicates([key]).write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
