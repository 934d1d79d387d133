"""Event log as a stream: windows, dedup with bounded state, numbering, and replay."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveworks.operators.lineage import folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TERMINAL = "error"


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Events of a folder or file; times become instants, as watermarks need them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        reader, path = reader.option("pathGlobFilter", hadoop.getName()), hadoop.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder, and reads it."""
    spark = rows.sparkSession
    base = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    q = rows.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "365 days") -> DataFrame:
    """First event of each key; state older than the watermark goes, unlike an unbounded set."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def numbered(events: DataFrame) -> DataFrame:
    """Events with 1, 2, 3 by user in order of arrival; the counter is the only state."""

    def run(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        parts = pd.concat(batches).sort_values("event_id")
        yield pd.DataFrame({"user_id": parts["user_id"], "event_id": parts["event_id"], "number": range(n + 1, n + 1 + len(parts))})
        state.update((n + len(parts),))

    return events.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, number long", "n long", "append", GroupStateTimeout.NoTimeout)


def since(events: DataFrame, last: int) -> DataFrame:
    return events.where(F.col("event_id") > last)


def until_terminal(events: DataFrame, terminal: str = TERMINAL) -> DataFrame:
    """Events of each user up to the first terminal one."""
    ends = events.where(F.col("event_type") == terminal).groupBy("user_id").agg(F.min("event_id").alias("_end"))
    return events.join(ends, "user_id", "left").where("_end IS NULL OR event_id <= _end").drop("_end")


def silent(events: DataFrame, seconds: int) -> DataFrame:
    """Users whose last event lies so long before the newest one, parts of a second counted."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    newest = events.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(newest)).where(F.unix_micros("now") / 1e6 - F.unix_micros("last") / 1e6 > seconds).select("user_id")
