"""Data quality: reject rates, reconciliation, table comparison, fingerprints and schema drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.config import POLICY_DATE
from tripspark.functions.exprs import flag, ratio, year_month
from tripspark.operators.clean import FLAGS, quality_counts


def quality_by_month(flagged: DataFrame, month: str = "src_month") -> DataFrame:
    counts = quality_counts(flagged, "service", month).withColumn("month", year_month(month)).drop(month)
    return counts.withColumn("reject_pct", 100.0 * ratio("n_rejected", "n_raw"))


def reject_rate_by_rule(flagged: DataFrame) -> DataFrame:
    """Percent of rows that break each rule, one row per service and rule."""
    counts = quality_counts(flagged, "service")
    long = counts.unpivot(["service", "n_raw"], list(FLAGS), "rule", "n_bad")
    return long.select("service", "rule", (100.0 * ratio("n_bad", "n_raw")).alias("pct"))


def fee_share_by_zone(trips: DataFrame, service: str, since: str = str(POLICY_DATE)) -> DataFrame:
    """Share of charged trips among those that start and end in the same zone."""
    inside = trips.where(
        (F.col("service") == service) & (F.col("pu") == F.col("dl")) & (F.col("pickup_ts") >= F.lit(since).cast("timestamp_ntz"))
    )
    return inside.groupBy(F.col("pu").alias("zone")).agg(
        F.count(F.lit(1)).alias("n_intra"), F.avg(flag(F.col("cbd_fee") > 0).cast("double")).alias("fee_share")
    )


def reconcile_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables holds, with the side that has them."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full_outer")
    side = F.when(F.col("_r").isNull(), "left").otherwise("right")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(*keys, side.alias("side"))


def compare_cells(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str], by: str) -> DataFrame:
    """Cell-by-cell comparison of two tables with the same keys, one row per ``by`` value and metric."""
    a = left.select(*keys, F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias("a"))
    b = right.select(*keys, F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias("b"))
    joined = a.join(b, keys)
    per_metric = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("x"), F.col(f"b.{m}").alias("y")) for m in metrics]
    )
    cells = joined.select(F.col(by), F.inline(per_metric))
    diff = F.abs(F.col("x") - F.col("y"))
    out = cells.groupBy(by, "metric").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum((F.col("x").isNull() != F.col("y").isNull()).cast("int")).alias("null_mismatch"),
        F.max(diff).alias("max_abs_diff"),
        F.max(F.try_divide(diff, F.nullif(F.abs(F.col("y")), F.lit(0.0)))).alias("max_rel_diff"),
        F.sum("x").alias("total_left"),
        F.sum("y").alias("total_right"),
    )
    exact = (F.coalesce(F.col("max_abs_diff"), F.lit(0.0)) == 0) & (F.col("null_mismatch") == 0)
    return out.withColumn("exact_match", exact)


def reconcile_layers(raw: DataFrame, logged: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Row balance of each partition: raw = processed, processed = rejected + kept, kept = stored.

    ``raw`` and ``stored`` hold the keys and a count column named n; ``logged`` the run log with
    n_raw, n_rejected and n_silver.
    """
    a = raw.select(*keys, F.col("n").alias("raw_rows"))
    b = logged.select(*keys, "n_raw", "n_rejected", "n_silver")
    c = stored.select(*keys, F.col("n").alias("stored_rows"))
    joined = a.join(b, keys, "full_outer").join(c, keys, "full_outer")
    ok = {
        "check_raw": F.col("raw_rows") == F.col("n_raw"),
        "check_balance": F.col("n_raw") == F.col("n_rejected") + F.col("n_silver"),
        "check_stored": F.coalesce(F.col("stored_rows"), F.lit(0)) == F.col("n_silver"),
    }
    return joined.withColumns({name: F.coalesce(cond, F.lit(False)) for name, cond in ok.items()})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fingerprint(df: DataFrame, table: str) -> DataFrame:
    """Row count and the sum of every numeric column, in long form."""
    cols = numeric_columns(df)
    sums = df.agg(F.count(F.lit(1)).cast("double").alias("_rows"), *[F.sum(F.col(c).cast("double")).alias(c) for c in cols])
    return sums.unpivot([], ["_rows", *cols], "measure", "total").select(F.lit(table).alias("table_name"), "measure", "total")


def regeneration_check(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Largest relative difference per table between two sets of fingerprints."""
    a = original.withColumnRenamed("total", "t0")
    b = rebuilt.withColumnRenamed("total", "t1")
    rel = F.abs(F.col("t0") - F.col("t1")) / F.greatest(F.abs(F.col("t0")), F.lit(1e-9))
    rows = F.max(F.when(F.col("measure") == "_rows", F.col("t0"))), F.max(F.when(F.col("measure") == "_rows", F.col("t1")))
    return (
        a.join(b, ["table_name", "measure"], "full_outer")
        .groupBy("table_name")
        .agg(rows[0].alias("rows_orig"), rows[1].alias("rows_new"), (F.count(F.lit(1)) - 1).alias("n_numeric_cols"), F.max(rel).alias("max_rel_diff"))
    )


def max_all_columns(df: DataFrame) -> DataFrame:
    """The maximum of every column."""
    return df.agg(*[F.max(c).alias(c) for c in df.columns])


def schema_table(schemas: DataFrame) -> DataFrame:
    """Fingerprint per (source, month) from a columns table (source, month, pos, name, type)."""
    text = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))), lambda s: F.concat(s["name"], F.lit(":"), s["type"])))
    return schemas.groupBy("source", "month").agg(F.substring(F.md5(text), 1, 10).alias("schema_fp"), F.count(F.lit(1)).alias("n_columns"))


def schema_fingerprints(schemas: DataFrame) -> DataFrame:
    """Distinct schemas per source with the first and last month that has each."""
    return (
        schema_table(schemas)
        .groupBy("source", "schema_fp")
        .agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("files"))
    )


def schema_drift(schemas: DataFrame) -> DataFrame:
    """Columns added, removed or retyped against the first month of each source; months without drift are left out."""
    first = schemas.groupBy("source").agg(F.min("month").alias("first_month"))
    base = schemas.join(first, "source").where(F.col("month") == F.col("first_month")).select("source", "name", F.col("type").alias("base_type"))
    months = schemas.select("source", "month").distinct()
    expected = months.join(base, "source")
    actual = schemas.select("source", "month", "name", "type")
    both = expected.join(actual, ["source", "month", "name"], "full_outer")

    def names(cond):
        picked = F.collect_list(F.when(cond, F.col("name")))
        return F.concat_ws(";", F.array_sort(picked))

    out = both.groupBy("source", "month").agg(
        names(F.col("base_type").isNull()).alias("added"),
        names(F.col("type").isNull()).alias("removed"),
        names(F.col("base_type") != F.col("type")).alias("type_changed"),
    )
    return out.where(reduce(lambda x, y: x | y, [F.col(c) != "" for c in ("added", "removed", "type_changed")]))


def compare_outputs(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Change of each numeric column between two versions of a result table, matched by key."""
    cols = [c for c in numeric_columns(new) if c not in keys]
    a = new.unpivot(keys, cols, "column_name", "v1") if len({new.schema[c].dataType for c in cols}) == 1 else _long(new, keys, cols, "v1")
    b = _long(old, keys, cols, "v0")
    diff = F.abs(F.col("v1") - F.col("v0"))
    joined = a.join(b, [*keys, "column_name"], "full_outer")
    return joined.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum(flag(F.col("v1").isNull() != F.col("v0").isNull())).alias("null_changes"),
        F.max(diff).alias("max_abs"),
        F.max(F.try_divide(diff, F.nullif(F.abs(F.col("v0")), F.lit(0.0)))).alias("max_rel"),
        F.max(flag(diff > 1e-9)).alias("changed"),
    )


def _long(df: DataFrame, keys: list[str], cols: list[str], value: str) -> DataFrame:
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(keys, cols, "column_name", value)


def pchart_laney(counts: DataFrame, series: str = "service", period: str = "month") -> DataFrame:
    """p-chart and Laney p' chart of a reject rate: limits, sigma_z from moving ranges, signals."""
    total = Window.partitionBy(series)
    ordered = Window.partitionBy(series).orderBy(period)
    pbar = F.sum("n_rejected").over(total) / F.sum("n_raw").over(total)
    out = counts.select(series, period, "n_raw", "n_rejected").withColumn("pbar", pbar)
    out = out.withColumn("p", F.col("n_rejected") / F.col("n_raw"))
    out = out.withColumn("sigma", F.sqrt(F.col("pbar") * (1 - F.col("pbar")) / F.col("n_raw")))
    out = out.withColumn("z", F.try_divide(F.col("p") - F.col("pbar"), F.col("sigma")))
    out = out.withColumn("mr", F.abs(F.col("z") - F.lag("z").over(ordered)))
    out = out.withColumn("sigma_z", F.avg("mr").over(total) / 1.128)
    wide = 3.0 * F.col("sigma") * F.col("sigma_z")
    return out.select(
        series,
        period,
        "p",
        "pbar",
        "sigma_z",
        (F.col("pbar") + 3.0 * F.col("sigma")).alias("ucl"),
        (F.col("pbar") - 3.0 * F.col("sigma")).alias("lcl"),
        (F.col("pbar") + wide).alias("ucl_laney"),
        F.greatest(F.col("pbar") - wide, F.lit(0.0)).alias("lcl_laney"),
        ((F.abs(F.col("z")) > 3).cast("int")).alias("out_p"),
        ((F.col("p") > F.col("pbar") + wide) | (F.col("p") < F.greatest(F.col("pbar") - wide, F.lit(0.0)))).cast("int").alias("out_laney"),
    )
