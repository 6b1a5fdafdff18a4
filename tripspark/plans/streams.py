"""Stream jobs on the events table; each is checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripspark.plans.registry import query
from tripspark.session import scratch_path
from tripspark.sources import sinks
from tripspark.streaming import hourly

_AGG = "CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_purchase, sum(value) AS value"
_CLOSED = "date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


def aggregates():
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("event_type") == "purchase").cast("long")).alias("n_purchase"),
        F.sum("value").alias("value"),
    ]


def run(t, path, sink, checkpoint, files_per_trigger=None):
    events = hourly.read_stream(t.spark, path, t.table("events").schema, files_per_trigger)
    return hourly.run_available(hourly.hourly(events, "ts", ["event_type"], aggregates()), sink, checkpoint)


def one_run(t):
    sink, check = scratch_path(t.spark, "sink"), scratch_path(t.spark, "check")
    q = run(t, f"{t.folder}/events*.parquet", sink, check, 1)
    return q, t.spark.read.parquet(sink)


@query("stream_tumbling_1h", f"SELECT date_trunc('hour', ts) AS hour, event_type, {_AGG} FROM events WHERE {_CLOSED} GROUP BY ALL", "value:4")
def stream_tumbling_1h(t):
    """Hourly windows by event type, as the stream writes them."""
    return hourly.flat(one_run(t)[1])


@query("stream_append_closed", f"SELECT date_trunc('hour', ts) AS hour, event_type, {_AGG} FROM events WHERE {_CLOSED} GROUP BY ALL", "value:4")
def stream_append_closed(t):
    """The batch twin: windows closed by the final watermark."""
    events = t.table("events")
    return hourly.flat(hourly.closed_windows(hourly.hourly(events, "ts", ["event_type"], aggregates()), events, "ts"))


def land(t, df, path):
    df.write.mode("append").parquet(path)


@query("stream_restart", f"SELECT date_trunc('hour', ts) AS hour, event_type, {_AGG} FROM events WHERE {_CLOSED} GROUP BY ALL", "value:4")
def stream_restart(t):
    """Three restarts from one checkpoint as files arrive; the result is that of one run."""
    landing, sink, check = (scratch_path(t.spark, n) for n in ("landing", "sink", "check"))
    events = t.table("events")
    for low, high in (("0001-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "9999-01-01")):
        land(t, events.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))), landing)
        run(t, landing, sink, check)
    return hourly.flat(t.spark.read.parquet(sink))


_LATE = "user_id % 10 = 3 AND ts < TIMESTAMP '2024-01-11'"


@query("stream_late_drop", f"SELECT date_trunc('hour', ts) AS hour, event_type, {_AGG} FROM events WHERE {_CLOSED} AND NOT ({_LATE}) GROUP BY ALL", "value:4")
def stream_late_drop(t):
    """Events that arrive after the watermark has passed are dropped."""
    landing, sink, check = (scratch_path(t.spark, n) for n in ("landing", "sink", "check"))
    events = t.table("events")
    late = (F.col("user_id") % 10 == 3) & (F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    for part in (events.where(~late), events.where(late)):
        land(t, part, landing)
        run(t, landing, sink, check)
    return hourly.flat(t.spark.read.parquet(sink))


@query("stream_hour_totals", f"SELECT hour, CAST(sum(n) AS BIGINT) AS n, sum(value) AS value FROM (SELECT date_trunc('hour', ts) AS hour, event_type, {_AGG} FROM events WHERE {_CLOSED} GROUP BY ALL) GROUP BY hour", "value:4")
def stream_hour_totals(t):
    """Totals per hour from the written windows."""
    return hourly.hour_totals(one_run(t)[1], ["n", "value"])


def logged_run(t):
    """A run over day files, one file a batch, with its progress table."""
    landing, sink, check, log = (scratch_path(t.spark, n) for n in ("landing", "sink", "check", "progress"))
    sinks.write_day_files(t.table("events"), landing, "ts")
    events = hourly.read_stream(t.spark, landing, t.table("events").schema, 1)
    hourly.run_logged(hourly.hourly(events, "ts", ["event_type"], aggregates()), sink, check, log)
    return hourly.read_progress(t.spark, log)


@query("stream_progress")
def stream_progress(t):
    """Rows, watermark and state of each micro-batch."""
    return logged_run(t)


@query("stream_input_rows", "SELECT CAST(count(*) AS BIGINT) AS input_rows, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS batches FROM events")
def stream_input_rows(t):
    """Rows and batches that the progress table of a whole run accounts for."""
    read = logged_run(t).where("input_rows > 0")
    return read.agg(F.sum("input_rows").alias("input_rows"), F.count(F.lit(1)).alias("batches"))
