"""Cleaning and the additive aggregate tables."""

from pyspark.sql import functions as F

from tripspark.operators import clean, gold, quality
from tripspark.plans.registry import query
from tripspark.plans.standin import RULES, SUM_ROUND, ZONE_RULES

_TRIP_COLS = (
    "service, company_code, request_ts, pickup_ts, dropoff_ts, pu, dl, miles, time_s, fare, tolls, bcf, tax, cong_sur,"
    " airport_fee, cbd_fee, tips, driver_pay, shared_req, shared_match, wav_req, total_amount, payment_type, src_month"
)
_MONEY = "miles:4 time_s:4 fare:4 tolls:4 bcf:4 tax:4 cong_sur:4 airport_fee:4 cbd_fee:4 tips:4 driver_pay:4 total_amount:4"
_FLAGS = ", ".join(clean.FLAGS)
_FLAG_SUMS = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in clean.FLAGS)
_BROKEN = " + ".join(clean.FLAGS)
_COUNTS = (
    f"CAST(count(*) AS BIGINT) AS n_raw, {_FLAG_SUMS}, CAST(count(*) FILTER (WHERE {_BROKEN} > 0) AS BIGINT) AS n_rejected,"
    f" CAST(count(*) FILTER (WHERE {_BROKEN} = 0) AS BIGINT) AS n_silver"
)


@query("standardize_union", f"SELECT {_TRIP_COLS} FROM trips", _MONEY)
def standardize_union(t):
    """Two raw schemas in one common schema."""
    return t.two_sources_from_files


@query("quality_flags", f"SELECT service, pu, dl, miles, time_s, fare, src_month, {_FLAGS} FROM flagged", "miles:4 time_s:4 fare:4")
def quality_flags(t):
    """Seven 0/1 flags per trip."""
    return t.flagged.select("service", "pu", "dl", "miles", "time_s", "fare", "src_month", *clean.FLAGS)


@query(
    "silver_clean",
    "SELECT * FROM silver",
    "miles time_s fare tolls bcf tax cong_sur airport_fee cbd_fee tips driver_pay total_amount wait_min mph rider_cost",
)
def silver_clean(t):
    """Rows that break no rule, with every column."""
    return t.silver


def _register_gold(name: str) -> None:
    @query(f"gold_{name}", f"SELECT * FROM {name}", SUM_ROUND)
    def build(t):
        return gold.build_gold(t.silver, name)


for _name in gold.TABLES:
    _register_gold(_name)


@query("quality_counts", f"SELECT {_COUNTS} FROM flagged")
def quality_counts(t):
    """Violations per rule and rejected rows over all trips."""
    return clean.quality_counts(t.flagged)


@query(
    "quality_by_month",
    f"SELECT *, 100.0e0 * n_rejected / n_raw AS reject_pct FROM (SELECT service, strftime(src_month, '%Y-%m') AS month, {_COUNTS} FROM flagged GROUP BY ALL)",
    "reject_pct",
)
def quality_by_month(t):
    """Violations per service and file month with the reject rate."""
    return quality.quality_by_month(t.flagged)


_RATES = " UNION ALL ".join(
    f"SELECT service, '{f}' AS rule, 100.0e0 * sum({f}) / count(*) AS pct FROM flagged GROUP BY service" for f in clean.FLAGS
)


@query("reject_rate_by_rule", _RATES, "pct")
def reject_rate_by_rule(t):
    """Violation rate per rule and service, in long form."""
    return quality.reject_rate_by_rule(t.flagged)


_CONSOLIDATED = ", ".join(
    f"sum(CAST({c} AS DOUBLE)) AS {c}" for c in gold.MEASURE_NAMES + gold.TABLES["zone_day_pu"][1]
)


@query(
    "gold_consolidate",
    f"SELECT service, d, zone, {_CONSOLIDATED} FROM zone_day_pu GROUP BY ALL ORDER BY service, d, zone",
    SUM_ROUND,
)
def gold_consolidate(t):
    """Partial tables per day chunk, merged by summing and sorted by key."""
    # one partial table per third of the month: the chunk number joins the key, as separate files would
    chunk = clean.day_chunk("pickup_ts", "src_month", 10, 3)
    parts = t.silver.withColumn("chunk", chunk).withColumn("zone", F.col("pu"))
    keys, extra = gold.TABLES["zone_day_pu"]
    measures = {**gold.measures(), **{c: gold._extras("CRZ")[c] for c in extra}}
    partial = parts.groupBy("chunk", *keys).agg(*[e.alias(n) for n, e in measures.items()])
    return gold.consolidate(partial, "zone_day_pu").orderBy("service", "d", "zone")


@query(
    "fee_share_by_zone",
    "SELECT pu AS zone, CAST(count(*) AS BIGINT) AS n_intra, avg(CASE WHEN cbd_fee > 0 THEN 1.0e0 ELSE 0.0e0 END) AS fee_share"
    " FROM trips WHERE service = 'hvfhv' AND pu = dl AND pickup_ts >= TIMESTAMP '2025-01-05' GROUP BY pu",
    "fee_share",
)
def fee_share_by_zone(t):
    """Share of trips inside a zone that paid the fee."""
    return quality.fee_share_by_zone(t.two_sources, "hvfhv")


_ZONE_SHARE = {
    "zone_share": "SELECT pu AS zone, avg(CASE WHEN cbd_fee > 0 THEN 1.0e0 ELSE 0.0e0 END) AS fee_share FROM trips"
    " WHERE service = 'hvfhv' AND pu = dl AND pickup_ts >= TIMESTAMP '2025-01-05' GROUP BY pu"
}


@query(
    "zone_classify",
    """SELECT z.zone, zone_name, borough, fee_share,
         CASE WHEN z.zone = 25 OR borough IS NULL THEN 'UNKNOWN' WHEN z.zone IN (5, 10, 15, 20) THEN 'AIRPORT'
              WHEN coalesce(fee_share, 0) >= 0.9 THEN 'CRZ' WHEN coalesce(fee_share, 0) >= 0.1 THEN 'CRZ_PARTIAL'
              WHEN borough = 'AMERICA' THEN 'MN_NORTH' ELSE 'OUTER' END AS grp
       FROM dim_zone AS z LEFT JOIN zone_share AS s ON z.zone = s.zone""",
    "fee_share",
    _ZONE_SHARE,
)
def zone_classify(t):
    """Zone groups from the measured fee share."""
    share = quality.fee_share_by_zone(t.two_sources, "hvfhv").select("zone", "fee_share")
    zones = t.dim_zone.drop("grp").join(share, "zone", "left")
    return clean.classify_zones(zones, rules=ZONE_RULES)


@query(
    "chunk_by_day_range",
    f"""SELECT service, src_month, CASE WHEN pickup_ts IS NOT NULL AND CAST(date_trunc('month', pickup_ts) AS DATE) = src_month
          THEN CAST(least((day(pickup_ts) - 1) // 8, 3) AS INTEGER) ELSE 3 END AS chunk,
          CAST(count(*) AS BIGINT) AS n_raw, CAST(sum(q_out_of_month) AS BIGINT) AS n_out
        FROM flagged GROUP BY ALL""",
)
def chunk_by_day_range(t):
    """Rows per day chunk of a file; rows without a valid day are in the last chunk."""
    chunk = clean.day_chunk("pickup_ts", "src_month", 8, 4).alias("chunk")
    return t.flagged.groupBy("service", "src_month", chunk).agg(
        F.count(F.lit(1)).alias("n_raw"), F.sum("q_out_of_month").alias("n_out")
    )


@query("flow_type", """SELECT service, CASE WHEN pu_grp = 'CRZ' AND do_grp = 'CRZ' THEN 'inside' WHEN pu_grp = 'CRZ' THEN 'outbound'
    WHEN do_grp = 'CRZ' THEN 'inbound' ELSE 'none' END AS ftype, CAST(count(*) AS BIGINT) AS n FROM silver GROUP BY ALL""")
def flow_type(t):
    """Trips per flow type."""
    return t.silver.groupBy("service", clean.flow_type().alias("ftype")).agg(F.count(F.lit(1)).alias("n"))


@query("hour_bins", """SELECT CASE WHEN hr <= 5 THEN '00-05' WHEN hr <= 9 THEN '06-09' WHEN hr <= 15 THEN '10-15'
      WHEN hr <= 19 THEN '16-19' ELSE '20-23' END AS hbin,
    CASE WHEN miles < 1 THEN '<1' WHEN miles < 2 THEN '1-2' WHEN miles < 3 THEN '2-3' WHEN miles < 5 THEN '3-5'
      WHEN miles < 10 THEN '5-10' ELSE '>10' END AS mbin, CAST(count(*) AS BIGINT) AS n FROM silver GROUP BY ALL""")
def hour_bins(t):
    """Right-closed hour bins by left-closed distance bins."""
    return t.silver.groupBy(clean.hour_bin().alias("hbin"), clean.distance_bin().alias("mbin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "impute_clip",
    """SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(CAST(l2.quality AS DOUBLE), 0.5) FROM documents
         LEFT JOIN labels AS l2 USING (doc_id))) AS quality, ln(greatest(CAST(n_chars AS DOUBLE), 400)) AS ln_chars
       FROM documents LEFT JOIN labels USING (doc_id)""",
    "quality ln_chars",
)
def impute_clip(t):
    """Median fill of missing labels and a floor before the logarithm."""
    docs = t.table("documents").select("doc_id", "n_chars").join(t.table("labels").select("doc_id", "quality"), "doc_id", "left")
    filled = clean.impute_median(docs, ["quality"])
    return filled.select("doc_id", "quality", F.ln(F.greatest(F.col("n_chars").cast("double"), F.lit(400.0))).alias("ln_chars"))


@query(
    "dummy_encode",
    "SELECT service, " + ", ".join(f"CAST(sum(CAST(dow = {k} AS INTEGER)) AS BIGINT) AS dow_{k}" for k in range(1, 8)) + " FROM silver GROUP BY service",
)
def dummy_encode(t):
    """Weekday dummies, summed per service."""
    wide = clean.dummies(t.silver.select("service", "dow"), "dow", list(range(1, 8)), "dow_")
    return wide.groupBy("service").agg(*[F.sum(f"dow_{k}").alias(f"dow_{k}") for k in range(1, 8)])
