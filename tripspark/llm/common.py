"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.session import checkpointed

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: A side of at most this many rows of a few longs (about 60 MB as a hash table) may be broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def sized(df: DataFrame) -> tuple[DataFrame, bool]:
    """The table, stored in the shared folder, and whether its counted rows are few enough to broadcast."""
    stored = checkpointed(df)
    return stored, stored.count() <= BROADCAST_ROWS


def join_sized(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """Join with a narrow table: broadcast within the counted bound, shuffled beyond it."""
    stored, small = sized(right)
    return left.join(F.broadcast(stored) if small else stored, on, how)


def hash_order(key: Column, salt: str) -> Column:
    """An order that depends on nothing but the key: the same in every run and after a lost task."""
    return F.xxhash64(F.lit(salt), key)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key written as text, modulo ``parts``."""
    return F.crc32(key.cast("string").cast("binary")) % parts
