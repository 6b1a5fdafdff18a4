"""Scans, sinks, logs and catalogues. Round trips write below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripspark.functions.exprs import ratio, year_month
from tripspark.operators import clean, quality
from tripspark.plans.registry import query
from tripspark.plans.standin import SUM_ROUND
from tripspark.session import scratch_path
from tripspark.sources import catalog, files, sinks

_COUNT = "CAST(count(*) AS BIGINT)"
_BY_MONTH = f"SELECT service, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, {_COUNT} AS n, sum(fare) AS fare FROM silver"


def by_month(df):
    return df.groupBy("service", "year", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("fare").alias("fare"))


def silver_root(t) -> str:
    t.stored_silver  # noqa: B018  (written on first use)
    return t.lake.path("silver")


@query("scan_parquet_files", f"{_BY_MONTH} WHERE d BETWEEN DATE '2025-01-01' AND DATE '2025-03-31' GROUP BY ALL", "fare:4")
def scan_parquet_files(t):
    """An explicit list of partition folders."""
    root = silver_root(t)
    wanted = t.spark.read.parquet(root).where("year = 2025 AND month IN (1, 2, 3)")
    paths = files.partition_paths(wanted, root, sinks.PARTITION_KEYS)
    return by_month(files.read_partitions(t.spark, root, paths))


@query("scan_hive_partitions", f"{_BY_MONTH} GROUP BY ALL", "fare:4")
def scan_hive_partitions(t):
    """The whole partitioned table, with typed partition columns."""
    return by_month(t.spark.read.parquet(silver_root(t)))


@query("scan_partition_pruned", f"{_BY_MONTH} WHERE service = 'hvfhv' AND year(d) = 2025 AND month(d) = 3 GROUP BY ALL", "fare:4")
def scan_partition_pruned(t):
    """Partition filters reach the file listing."""
    return by_month(t.spark.read.parquet(silver_root(t)).where("service = 'hvfhv' AND year = 2025 AND month = 3"))


@query("scan_column_pruned", f"SELECT {_COUNT} AS n, sum(fare) AS fare, sum(miles) AS miles FROM silver", "fare:4 miles:4")
def scan_column_pruned(t):
    """Two columns of a wide table."""
    return t.stored_silver.agg(F.count(F.lit(1)).alias("n"), F.sum("fare").alias("fare"), F.sum("miles").alias("miles"))


@query(
    "scan_time_range",
    f"SELECT {_COUNT} AS n, sum(fare) AS fare FROM silver WHERE pickup_ts >= TIMESTAMP '2025-03-15' AND pickup_ts < TIMESTAMP '2025-03-16'",
    "fare:4",
)
def scan_time_range(t):
    """One day: the time filter skips row groups, and the month it implies prunes folders."""
    day = "year = 2025 AND month = 3 AND pickup_ts >= TIMESTAMP_NTZ'2025-03-15' AND pickup_ts < TIMESTAMP_NTZ'2025-03-16'"
    return t.stored_silver.where(day).agg(F.count(F.lit(1)).alias("n"), F.sum("fare").alias("fare"))


@query("scan_zone_filter", f"SELECT {_COUNT} AS n, sum(fare) AS fare FROM silver WHERE pu = 7", "fare:4")
def scan_zone_filter(t):
    """The contrast: a filter on a column the files are not sorted by."""
    return t.stored_silver.where("pu = 7").agg(F.count(F.lit(1)).alias("n"), F.sum("fare").alias("fare"))


@query(
    "union_by_name_widen",
    "SELECT service, sum(fare) AS fare, sum(cbd) AS cbd, CAST(sum(n_x) AS BIGINT) AS n_x FROM (SELECT service, fare, cbd, CASE WHEN service = 'yellow' THEN n END AS n_x FROM zone_day_pu) GROUP BY ALL",
    "fare:4 cbd:4",
)
def union_by_name_widen(t):
    """Files with different columns and types: decimal next to double, and a column only some have."""
    g = t.gold("zone_day_pu")
    a, b = scratch_path(t.spark, "widen-a"), scratch_path(t.spark, "widen-b")
    # cbd as decimal in one file and double in the other
    g.where("service = 'hvfhv'").select("service", "fare", F.col("cbd").cast("decimal(38,4)").alias("cbd")).write.parquet(a)
    g.where("service = 'yellow'").select("service", "cbd", F.col("n").alias("n_x"), "fare").write.parquet(b)
    both = files.union_by_name([t.spark.read.parquet(a), t.spark.read.parquet(b)])
    return both.groupBy("service").agg(F.sum("fare").alias("fare"), F.sum("cbd").alias("cbd"), F.sum("n_x").alias("n_x"))


def _csv(t, **options):
    """Every column of a table as CSV with header, read back with the table's own schema."""
    table = t.gold("zone_day_pu")
    path = scratch_path(t.spark, "csv")
    table.write.options(header=True, **options).csv(path)
    return t.spark.read.schema(table.schema).csv(path, header=True)


@query("csv_roundtrip", "SELECT * FROM zone_day_pu", SUM_ROUND)
def csv_roundtrip(t):
    """CSV compressed with gzip."""
    return _csv(t, compression="gzip")


@query("csv_plain_roundtrip", "SELECT * FROM zone_day_pu", SUM_ROUND)
def csv_plain_roundtrip(t):
    """CSV without compression."""
    return _csv(t)


def _parquet(t, codec):
    path = scratch_path(t.spark, codec)
    t.gold("od_month").write.option("compression", codec).parquet(path)
    return t.spark.read.parquet(path)


@query("parquet_zstd_roundtrip", "SELECT * FROM od_month", SUM_ROUND)
def parquet_zstd_roundtrip(t):
    """Parquet with Zstandard compression, every column."""
    return _parquet(t, "zstd")


@query("parquet_snappy_roundtrip", "SELECT * FROM od_month", SUM_ROUND)
def parquet_snappy_roundtrip(t):
    """Parquet with Snappy compression, every column."""
    return _parquet(t, "snappy")


@query("silver_partitioned_write", f"{_BY_MONTH} GROUP BY ALL", "fare:4")
def silver_partitioned_write(t):
    """Cleaned trips by service, year and month, sorted by time in each file."""
    path = scratch_path(t.spark, "silver")
    sinks.write_silver(t.silver, path)
    return by_month(t.spark.read.parquet(path))


@query("incremental_partitions", f"SELECT service, src_month, {_COUNT} AS n, sum(fare) AS fare FROM silver GROUP BY ALL", "fare:4")
def incremental_partitions(t):
    """Three runs: the early months, everything, and nothing left to do."""
    table, log = scratch_path(t.spark, "inc"), scratch_path(t.spark, "inc-log")
    keys = ["service", "src_month"]
    rows = t.trips.select(*keys, "fare")

    def summarise(df):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("fare").alias("fare"))

    for upto in ("2023-12-31", "9999-12-31", "9999-12-31"):
        sinks.process_incrementally(rows.where(F.col("src_month") <= F.lit(upto).cast("date")), keys, table, log, summarise)
    return t.spark.read.schema("n long, fare double, service string, src_month date").parquet(table)


def write_logs(t) -> str:
    """One JSON record per partition, as the monthly job writes them."""
    path = scratch_path(t.spark, "logs")
    counts = clean.quality_counts(t.flagged, "service", "src_month").withColumn("month", year_month("src_month"))
    n = F.col("n_raw").cast("double")
    counts.select("service", "month", "n_raw", "n_rejected", "n_silver", (n / 1e5).alias("sec_quality"), (n / 2e4).alias("sec_silver"), (n / 5e4).alias("sec_gold"), (n * 8e-5).alias("sec_total")).write.json(path)
    return path


_BROKEN = " + ".join(clean.FLAGS)
_LOGS = {
    "logs": f"""SELECT service, strftime(src_month, '%Y-%m') AS month, {_COUNT} AS n_raw, CAST(count(*) FILTER (WHERE {_BROKEN} > 0) AS BIGINT) AS n_rejected,
        CAST(count(*) FILTER (WHERE {_BROKEN} = 0) AS BIGINT) AS n_silver, count(*) * 8e-5 AS sec_total, count(*) / 5e4 AS sec_gold FROM flagged GROUP BY ALL"""
}


@query("json_log_scan", "SELECT service, month, n_raw, n_rejected, n_silver, sec_total FROM logs", "sec_total", _LOGS)
def json_log_scan(t):
    """Run logs from many small JSON files."""
    return files.read_run_logs(t.spark, write_logs(t)).select("service", "month", "n_raw", "n_rejected", "n_silver", "sec_total")


@query(
    "run_log_accounting",
    """SELECT service, CAST(count(*) AS BIGINT) AS parts, CAST(sum(n_raw) AS BIGINT) AS n_raw, sum(sec_total) AS sec_total, sum(sec_gold) AS sec_gold, median(sec_total) AS sec_median,
         sum(n_raw) / sum(sec_total) AS rows_per_s, sum(sec_total) * 2 / (sum(n_raw) / 1e6) AS core_s_per_million FROM logs GROUP BY service""",
    "sec_total sec_gold sec_median rows_per_s:3 core_s_per_million",
    _LOGS,
)
def run_log_accounting(t):
    """Time, throughput and resources per service from the run logs."""
    logs = files.read_run_logs(t.spark, write_logs(t))
    s = logs.groupBy("service").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n_raw").alias("n_raw"), F.sum("sec_total").alias("sec_total"), F.sum("sec_gold").alias("sec_gold"),
        F.percentile("sec_total", F.lit(0.5)).alias("sec_median"),
    )
    return s.withColumns({"rows_per_s": ratio("n_raw", "sec_total"), "core_s_per_million": ratio(F.col("sec_total") * 2, F.col("n_raw") / 1e6)})


@query("file_catalog")
def file_catalog(t):
    """Footers of all Parquet files of the test folder and of the cleaned table, per layer."""
    raw = catalog.file_catalog(catalog.list_files(t.spark, t.folder)).withColumn("layer", F.lit("raw"))
    silver = catalog.file_catalog(catalog.list_files(t.spark, silver_root(t))).withColumn("layer", F.lit("silver"))
    both = raw.unionByName(silver)
    return both.groupBy("layer", "schema_fp", "compression").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("columns"),
        F.sum("n_row_groups").alias("row_groups"), F.sum("bytes").alias("bytes"),
    )


@query("rowgroup_stats")
def rowgroup_stats(t):
    """Time range of every row group of the cleaned table."""
    stats = catalog.row_group_stats(catalog.list_files(t.spark, silver_root(t)), "pickup_ts")
    name = F.regexp_extract("path", r"service=([^/]+)/year=(\d+)/month=(\d+)", 0).alias("partition")
    return stats.select(name, "row_group", "n_rows", "min_value", "max_value")


@query("sha256_manifest")
def sha256_manifest(t):
    """Digests of the raw files; half are known from an earlier run, and some are verified again."""
    listed = catalog.list_files(t.spark, t.folder)
    path = scratch_path(t.spark, "manifest")
    first = listed.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 0)
    catalog.sha256_manifest(first).write.parquet(path)
    full = catalog.sha256_manifest(listed, t.spark.read.parquet(path))
    checked = catalog.verify_manifest(t.spark.read.parquet(path))
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    return full.join(checked, "path", "left").select(name, "bytes", "sha256", "match")


_NAMES = ["License", "Apache", "MIT", "the", "der", "que", "les", "example"]


@query(
    "lineage_edges",
    f"""SELECT source, name, {_COUNT} AS docs, CAST(sum(times) AS BIGINT) AS times FROM (
          SELECT doc_id, source, name, count(*) AS times FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents)
          WHERE name IN ({", ".join(f"'{n}'" for n in _NAMES)}) GROUP BY ALL) GROUP BY ALL""",
)
def lineage_edges(t):
    """Which sources mention which known names, over whole texts."""
    names = t.spark.createDataFrame([(n,) for n in _NAMES], "name string")
    docs = t.table("documents")
    found = files.mentions(docs, "doc_id", "text", names)
    return found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "name").agg(F.count(F.lit(1)).alias("docs"), F.sum("times").alias("times"))


@query("split_by_day", "SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, sum(value) AS value FROM events GROUP BY ALL", "value:4")
def split_by_day(t):
    """One folder per day, sorted inside, read back."""
    path = scratch_path(t.spark, "days")
    sinks.write_day_files(t.table("events"), path, "ts")
    return t.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("slice_limit", "SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 2000", "value:4")
def slice_limit(t):
    """The first rows of a total order."""
    return t.table("events").orderBy("ts", "event_id").limit(2000).select("event_id", "user_id", "value")


def schema_months(t):
    """(source, month, n_rows, pos, name, type) of the monthly raw files, each from its own footer."""
    listed = None
    for source in ("hvfhv", "yellow"):
        columns = catalog.footer_columns(catalog.list_files(t.spark, t.raw_files(source)))
        month = F.regexp_extract("path", r"month=([0-9-]+)", 1)
        part = columns.groupBy(month.alias("month"), "pos", "name", "type").agg(F.sum("n_rows").alias("n_rows"))
        part = part.select(F.lit(source).alias("source"), "month", "n_rows", "pos", "name", "type")
        listed = part if listed is None else listed.unionByName(part)
    return listed


@query(
    "schema_drift",
    f"""SELECT source, month, {_COUNT} AS n_rows, 'cbd_congestion_fee' AS added, '' AS removed,
          CASE WHEN source = 'hvfhv' AND month > '2025-01' THEN 'PULocationID' ELSE '' END AS type_changed
        FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'hvfhv' ELSE 'yellow' END AS source, strftime(src_month, '%Y-%m') AS month FROM lines)
        WHERE month >= '2025-01' GROUP BY source, month""",
)
def schema_drift(t):
    """Columns added, removed or retyped in each monthly file against the first month, with the rows concerned."""
    months = schema_months(t)
    rows = months.groupBy("source", "month").agg(F.max("n_rows").alias("n_rows"))
    return quality.schema_drift(months).join(rows, ["source", "month"])


@query(
    "schema_fingerprints",
    f"""SELECT source, kind, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month)::BIGINT AS files, {_COUNT} AS n_rows FROM (
          SELECT *, CASE WHEN month < '2025-01' THEN 1 WHEN source = 'yellow' OR month = '2025-01' THEN 2 ELSE 3 END AS kind FROM (
            SELECT CASE WHEN l_linestatus = 'O' THEN 'hvfhv' ELSE 'yellow' END AS source, strftime(src_month, '%Y-%m') AS month FROM lines)) GROUP BY source, kind""",
)
def schema_fingerprints(t):
    """Distinct schemas per source, numbered by their first month, with the files and rows that have each."""
    months = schema_months(t)
    per_month = quality.schema_table(months).join(months.groupBy("source", "month").agg(F.max("n_rows").alias("n_rows")), ["source", "month"])
    rows = per_month.groupBy("source", "schema_fp").agg(F.sum("n_rows").alias("n_rows"))
    kinds = quality.schema_fingerprints(months).join(rows, ["source", "schema_fp"])
    order = Window.partitionBy("source").orderBy("first_month")
    return kinds.select("source", F.row_number().over(order).alias("kind"), "first_month", "last_month", "files", "n_rows")


@query("cached_reuse", f"SELECT 'zones' AS what, {_COUNT} AS n, sum(fare) AS fare FROM zone_day_pu UNION ALL SELECT 'hours', {_COUNT}, sum(fare) FROM grp_hour_day", "fare:4")
def cached_reuse(t):
    """Several queries over one selected table that is kept in memory."""
    from pyspark import StorageLevel

    month = t.trips.persist(StorageLevel.MEMORY_AND_DISK)
    zones = month.groupBy("service", "d", "pu").agg(F.sum("fare").alias("fare"))
    hours = month.groupBy("service", "d", "hr", "pu_grp", "do_grp").agg(F.sum("fare").alias("fare"))
    rows = [(name, *g.agg(F.count(F.lit(1)), F.sum("fare")).first()) for name, g in (("zones", zones), ("hours", hours))]
    month.unpersist()
    return t.spark.createDataFrame(rows, "what string, n long, fare double")
