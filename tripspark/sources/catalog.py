"""File catalogue: Parquet footers, row-group statistics and SHA-256 manifests.

The file list comes from Spark's own listing; tasks open the files, one footer or stream at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = (
    "path string, bytes long, n_rows long, n_row_groups int, n_columns int, compression string, created_by string, schema_fp string"
)
STATS_SCHEMA = "path string, row_group int, column_name string, n_rows long, n_nulls long, min_value string, max_value string"
HASH_SCHEMA = "path string, bytes long, modified timestamp, sha256 string"
CHUNK = 8 << 20


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Path, size and modification time of files below a folder. Contents are pruned away: only the listing is read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _spread(files: DataFrame) -> DataFrame:
    """One file per task where possible: file work is uneven and independent."""
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, 1), "path")


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for pdf in batches:
        rows = []
        for path, size in zip(pdf["path"], pdf["bytes"], strict=True):
            system, inner = _open(path)
            f = pq.ParquetFile(inner, filesystem=system)
            m, schema = f.metadata, f.schema_arrow
            text = ";".join(f"{c.name}:{c.type}" for c in schema)
            codec = m.row_group(0).column(0).compression if m.num_row_groups and m.num_columns else ""
            fp = hashlib.md5(text.encode()).hexdigest()[:10]
            rows.append((path, int(size), m.num_rows, m.num_row_groups, m.num_columns, codec, m.created_by, fp))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CATALOG_SCHEMA.split(", ")])


def file_catalog(files: DataFrame) -> DataFrame:
    """Rows, row groups, columns, codec, writer and schema fingerprint of each Parquet file."""
    return _spread(files).mapInPandas(_footers, CATALOG_SCHEMA)


def _columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            system, inner = _open(path)
            f = pq.ParquetFile(inner, filesystem=system)
            rows += [(path, f.metadata.num_rows, i, c.name, str(c.type)) for i, c in enumerate(f.schema_arrow)]
        yield pd.DataFrame(rows, columns=["path", "n_rows", "pos", "name", "type"])


def footer_columns(files: DataFrame) -> DataFrame:
    """(path, n_rows, pos, name, type): the schema of each file, from its own footer, read in tasks."""
    return _spread(files).mapInPandas(_columns, "path string, n_rows long, pos int, name string, type string")


def _row_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    names = [c.split()[0] for c in STATS_SCHEMA.split(", ")]
    for pdf in batches:
        for path in pdf["path"]:
            system, inner = _open(path)
            m = pq.ParquetFile(inner, filesystem=system).metadata
            rows = []
            for g in range(m.num_row_groups):
                group = m.row_group(g)
                for c in range(group.num_columns):
                    col = group.column(c)
                    s = col.statistics
                    has = s is not None and s.has_min_max
                    nulls = int(s.null_count) if s is not None and s.has_null_count else None
                    low, high = (str(s.min), str(s.max)) if has else (None, None)
                    rows.append((path, g, col.path_in_schema, group.num_rows, nulls, low, high))
            yield pd.DataFrame(rows, columns=names).astype({"n_nulls": "Int64"})


def row_group_stats(files: DataFrame, column: str | None = None) -> DataFrame:
    """Minimum and maximum per row group, looked up by column name."""
    stats = _spread(files).mapInPandas(_row_groups, STATS_SCHEMA)
    return stats if column is None else stats.where(F.col("column_name") == column)


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, size, modified in zip(pdf["path"], pdf["bytes"], pdf["modified"], strict=True):
            system, inner = _open(path)
            h = hashlib.sha256()
            with system.open_input_stream(inner) as stream:
                while chunk := stream.read(CHUNK):
                    h.update(chunk)
            rows.append((path, int(size), modified, h.hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "bytes", "modified", "sha256"])


def sha256_manifest(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """SHA-256 per file, read in chunks; files of unchanged size and time in ``known`` are not hashed again."""
    if known is None:
        return _spread(files).mapInPandas(_hashes, HASH_SCHEMA)
    same = ["path", "bytes", "modified"]
    fresh = files.join(known.select(*same), same, "left_anti")
    kept = known.join(files, same, "left_semi")
    return kept.unionByName(_spread(fresh).mapInPandas(_hashes, HASH_SCHEMA))


def verify_manifest(manifest: DataFrame, sample: int = 3, seed: int = 0) -> DataFrame:
    """Hash a few files again, chosen by hash of their path, and compare."""
    from tripspark.functions.exprs import uniform01

    picked = manifest.orderBy(uniform01(F.lit(seed), "path"), "path").limit(sample)
    again = _spread(picked.select("path", "bytes", "modified")).mapInPandas(_hashes, HASH_SCHEMA).withColumnRenamed("sha256", "again")
    return picked.join(again.select("path", "again"), "path").select("path", (F.col("sha256") == F.col("again")).alias("match"))
