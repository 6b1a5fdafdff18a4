"""Readers: explicit file lists, schema drift across files, logs, and text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_partitions(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """The listed folders of a partitioned table, with their partition columns."""
    return spark.read.option("basePath", root).parquet(*paths)


def partition_paths(table: DataFrame, root: str, keys: Sequence[str]) -> list[str]:
    """Folders of the partitions that ``table`` still holds after its filters; only partition metadata is read."""
    rows = table.select(*keys).distinct().collect()
    return [root + "".join(f"/{k}={v}" for k, v in zip(keys, r, strict=True)) for r in rows]


_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: any mix with a decimal or a floating number becomes double."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if type(a) in _WIDTH and type(b) in _WIDTH:
        return a if _WIDTH.index(type(a)) >= _WIDTH.index(type(b)) else b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables whose columns differ: by name, missing columns NULL, types widened.

    A reader that merges schemas refuses decimal next to double, and taking the first file's type
    would round 0.75 to 0.8 in a one-digit decimal.
    """
    target: dict[str, T.DataType] = {}
    for p in parts:
        for f in p.schema.fields:
            target[f.name] = wider(target.get(f.name, T.NullType()), f.dataType)
    out = None
    for p in parts:
        typed = p.select(
            *[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in target.items()]
        )
        out = typed if out is None else out.union(typed)
    return out


def columns_table(spark: SparkSession, tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Column list of several (source, month) files: (source, month, pos, name, type)."""
    rows = [
        (source, month, i, f.name, f.dataType.simpleString())
        for (source, month), df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "source string, month string, pos int, name string, type string")


RUN_LOG_SCHEMA = "service string, month string, n_raw long, n_rejected long, n_silver long, sec_quality double, sec_silver double, sec_gold double, sec_total double"


def read_run_logs(spark: SparkSession, path: str, schema: str = RUN_LOG_SCHEMA) -> DataFrame:
    """Many small JSON files with a given schema: no pass to infer it."""
    return spark.read.schema(schema).json(path)


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """Which of the known names each whole text mentions as a word: (key, name, times).

    Words are cut out once per text and joined with the names, instead of one pattern per name.
    """
    words = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias(name))
    return words.join(names.select(name), name).groupBy(key, name).agg(F.count(F.lit(1)).alias("times"))
