"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, comma separated).
The lake (cleaned trips, aggregates, panels) is built once and timed on its own; the other queries
read it, as they would in production. Every result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import time

from tripspark.plans.catalog import QUERIES
from tripspark.plans.standin import StandIn
from tripspark.session import local_session

HEADLINE = [
    # straight from the raw tables
    "gold_zone_day_pu", "quality_counts", "quality_by_month",
    # scans of the stored trips
    "scan_partition_pruned", "scan_column_pruned", "scan_time_range", "quantiles_by_group", "k_anonymity", "trip_rules",
    # descriptive tables and windows
    "desc_group_year", "zone_detail", "robust_daily_anomaly", "calendar_features",
    # estimates and inference
    "did_twfe", "did_specs", "event_study", "long_event_study", "permutation_test", "wild_bootstrap", "romano_wolf", "conley_se",
    "trend_specs", "rr_bootstrap", "dp_laplace_did", "fe_ols_multi",
    # solvers and learners
    "synthetic_control", "scm_placebo", "crossfit_nuisance", "isolation_forest",
    # files, space and streams
    "csv_roundtrip", "parquet_zstd_roundtrip", "adjacency_within", "adjacency_rings", "stream_tumbling_1h",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = os.environ.get("BENCH_QUERIES")
    names = picked.split(",") if picked else HEADLINE
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    t = StandIn(spark, folder)
    times = {
        "lake_silver": timed(lambda: t.stored_silver),
        "lake_zone_day_pu": timed(lambda: t.gold("zone_day_pu")),
        "lake_panel_week": timed(lambda: t.panel_week),
    }
    rows = t.stored_silver.count()
    for name in names:
        times[name] = timed(lambda name=name: run(QUERIES[name](spark, folder)))
    zone_day = times["lake_zone_day_pu"]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "silver_rows": rows,
                "zone_day_rows_per_s": round(rows / zone_day) if zone_day else None,
            }
        )
    )


if __name__ == "__main__":
    main()
