"""Hourly windows over an event stream, and the batch job that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

WATERMARK = "2 hours"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = 1) -> DataFrame:
    """A file stream with a given schema; each micro-batch takes a bounded number of files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hourly(events: DataFrame, ts: str, keys: list[str], aggregates: list[Column], delay: str = WATERMARK, width: str = "1 hour") -> DataFrame:
    """Tumbling windows by key. Works on streams and on tables alike.

    Times without a zone are cast: a watermark needs a timestamp with one.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, width).alias("window"), *keys).agg(*aggregates)


def run_available(agg: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there in append mode, then stop. A later call with the same checkpoint goes on.

    Append mode writes a window once, when the watermark has passed its end.
    """
    q = (
        agg.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def closed_windows(agg: DataFrame, events: DataFrame, ts: str, delay: str = WATERMARK) -> DataFrame:
    """Of a batch aggregate, the windows that a stream has written after reading the same events."""
    newest = events.agg(F.max(F.col(ts).cast("timestamp"))).scalar()
    return agg.where(F.col("window.end") <= newest - F.expr(f"INTERVAL {delay}"))


def flat(df: DataFrame) -> DataFrame:
    """Window start as a plain time column."""
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), *[c for c in df.columns if c != "window"])


def hour_totals(sink: DataFrame, value_columns: list[str]) -> DataFrame:
    """Totals over all keys per hour, from the written windows."""
    return flat(sink).groupBy("hour").agg(*[F.sum(c).alias(c) for c in value_columns])


PROGRESS_SCHEMA = (
    "batch long, input_rows long, trigger_ms long, add_batch_ms long, watermark string, state_rows long, dropped_late long, state_bytes long"
)


def _progress_row(d: dict) -> tuple:
    state = (d.get("stateOperators") or [{}])[0]
    ms = d.get("durationMs", {})
    return (
        d["batchId"], d["numInputRows"], ms.get("triggerExecution"), ms.get("addBatch"), (d.get("eventTime") or {}).get("watermark"),
        state.get("numRowsTotal"), state.get("numRowsDroppedByWatermark"), state.get("memoryUsedBytes"),
    )


def run_logged(agg: DataFrame, path: str, checkpoint: str, log: str, poll: float = 0.05, flush: int = 1000) -> StreamingQuery:
    """`run_available` that writes one row for each micro-batch to the table ``log`` while the stream runs.

    Spark keeps only the last batches in its history, so the history is read again and again and what is new is taken
    over; ``flush`` rows at most wait on the driver. A batch that left the history unseen raises: a log has no gaps.
    """
    spark = agg.sparkSession
    q = agg.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    waiting, last = [], None

    def take() -> None:
        nonlocal last
        for p in q.recentProgress:
            d = json.loads(p.json) if hasattr(p, "json") else p
            if last is not None and d["batchId"] <= last:
                continue
            if last is not None and d["batchId"] > last + 1:
                q.stop()
                raise RuntimeError(f"batches {last + 1} to {d['batchId'] - 1} left the progress history unseen; poll more often or raise spark.sql.streaming.numRecentProgressUpdates")
            waiting.append(_progress_row(d))
            last = d["batchId"]

    def write() -> None:
        if waiting:
            spark.createDataFrame(waiting, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(log)
            waiting.clear()

    while True:
        ended = q.awaitTermination(poll)  # also raises what stopped the stream
        take()
        if ended or len(waiting) >= flush:
            write()
        if ended:
            return q


def read_progress(spark: SparkSession, log: str) -> DataFrame:
    """The table of `run_logged`: rows, times, watermark and state of each micro-batch."""
    return spark.read.schema(PROGRESS_SCHEMA).parquet(log)
