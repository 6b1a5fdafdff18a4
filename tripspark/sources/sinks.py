"""Writers: partitioned trips, compressed files, day files, and incremental partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_KEYS = ("service", "year", "month")
ROWS_PER_FILE = 20_000_000


def with_partition_keys(trips: DataFrame) -> DataFrame:
    return trips.withColumns({"year": F.year("d"), "month": F.month("d")})


def write_silver(
    trips: DataFrame,
    path: str,
    mode: str = "overwrite",
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Cleaned trips as Parquet by service, year and month, sorted by time inside each file.

    Rows are rebalanced by month: adaptive execution merges small months and splits large ones into tasks of the
    advisory size, so no task opens every folder and no month, however large, falls to one task. The sort makes row
    groups narrow in time, which lets later scans skip them.
    """
    keyed = with_partition_keys(trips)
    (
        keyed.hint("rebalance", *PARTITION_KEYS)
        .sortWithinPartitions(*PARTITION_KEYS, "pickup_ts")
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*PARTITION_KEYS)
        .parquet(path)
    )


def write_day_files(df: DataFrame, path: str, ts: str) -> None:
    """One folder per day, files sorted by time: the landing layout of the stream job. Large days are split."""
    dated = df.withColumn("day", F.col(ts).cast("date"))
    dated.hint("rebalance", "day").sortWithinPartitions("day", ts).write.mode("overwrite").partitionBy("day").parquet(path)


def pending_partitions(wanted: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions that the run log does not list as done."""
    return wanted.join(log.select(*keys), keys, "left_anti")


def process_incrementally(
    source: DataFrame, keys: list[str], table: str, log: str, transform: Callable[[DataFrame], DataFrame]
) -> None:
    """Process the partitions of ``source`` that are not in the log yet, then add them to the log.

    Each partition folder is replaced as a whole, so a run that died between the write and the
    log entry can simply be repeated.
    """
    spark = source.sparkSession
    wanted = source.select(*keys).distinct()
    todo = pending_partitions(wanted, spark.read.parquet(log), keys) if _exists(spark, log) else wanted
    todo = todo.persist()
    try:
        if todo.isEmpty():
            return
        fresh = transform(source.join(todo, keys, "left_semi"))
        (
            fresh.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(table)
        )
        todo.write.mode("append").parquet(log)
    finally:
        todo.unpersist()


def _exists(spark: SparkSession, path: str) -> bool:
    """True if the path holds a readable table."""
    try:
        return len(spark.read.parquet(path).columns) > 0
    except Exception as e:  # a missing path is an analysis error; anything else is a real failure
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
