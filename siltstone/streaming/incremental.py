"""Incremental indexing as a stream: arriving source files become chunk rows, the latest version of a file wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import code
from siltstone.schemas import ERRORS

ARRIVALS = "relative_path STRING, content BINARY, sha256 STRING, seen_at TIMESTAMP"
VERSION = "relative_path STRING, sha256 STRING, seen_at TIMESTAMP, batch INT"
ERROR = f"{ERRORS}, batch INT"


def _order(*more: str) -> Column:
    """Later arrivals win, of equal times the greater hash."""
    return F.struct("seen_at", "sha256", *more)


def latest(rows: DataFrame) -> DataFrame:
    """The last arrival of each path."""
    last = F.max_by(F.struct("content", "sha256", "seen_at"), _order()).alias("last")
    return rows.groupBy("relative_path").agg(last).select("relative_path", "last.content", "last.sha256", "last.seen_at")


def start(spark: SparkSession, arrivals: str, chunks: str, checkpoint: str) -> StreamingQuery:
    """Watch a folder of Parquet files of arrivals and write each batch's versions, chunks and errors under ``chunks``.

    A batch that is run again overwrites its own folders, so its rows never double. ``current`` reads
    what holds after all batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = latest(batch).persist()
        try:
            good, bad = code.split_errors(code.chunks(fresh), "chunk")
            good.write.mode("overwrite").parquet(f"{chunks}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{chunks}-errors/batch={number}")
            # Last: a version counts only when its chunks are there.
            fresh.drop("content").write.mode("overwrite").parquet(f"{chunks}-versions/batch={number}")
        finally:
            fresh.unpersist()

    stream = spark.readStream.schema(ARRIVALS).parquet(arrivals)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _of_last_version(spark: SparkSession, rows: DataFrame, chunks: str) -> DataFrame:
    versions = spark.read.schema(VERSION).parquet(f"{chunks}-versions")
    last = versions.groupBy("relative_path").agg(F.max_by("batch", _order("batch")).alias("batch"))
    return rows.join(last, ["relative_path", "batch"], "left_semi").drop("batch")


def current(spark: SparkSession, chunks: str) -> DataFrame:
    """The chunks of the latest version of every file over all batches; a version without chunks leaves none."""
    return _of_last_version(spark, spark.read.option("mergeSchema", "true").parquet(chunks), chunks)


def current_errors(spark: SparkSession, chunks: str) -> DataFrame:
    """The errors of the latest version of every file."""
    return _of_last_version(spark, spark.read.schema(ERROR).parquet(f"{chunks}-errors"), chunks)


def event_rates(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Calls and mean value per window and type; events later than ``late`` are dropped by the watermark.

    Windows follow each other, or begin every ``slide`` and overlap.
    """
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("calls"), F.avg("value").alias("mean_value"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between neighbours: their time, number and sum of values."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("calls"), F.sum("value").alias("total"))
