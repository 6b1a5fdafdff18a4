"""Descriptive tables computed from the aggregates."""

from pyspark.sql import functions as F

from tripspark.functions import exprs
from tripspark.functions.exprs import ratio, week_ending, year_month
from tripspark.operators import clean, gold, panel, reshape, timeops
from tripspark.plans.registry import query

HOUR = 3600.0
_RATIOS = """ln(n) AS ln_n, fare / nullif(miles, 0) AS fare_pm, pay / nullif(miles, 0) AS pay_pm, fare / nullif(n, 0) AS fare_pt,
  pay / nullif(n, 0) AS pay_pt, miles / nullif(time_s / 3600.0e0, 0) AS mph, time_s / nullif(n, 0) / 60.0e0 AS min_pt,
  miles / nullif(n, 0) AS miles_pt, wait_sum / nullif(wait_n, 0) AS wait, rider_cost / nullif(n, 0) AS rider_pt,
  cbd / nullif(n, 0) AS cbd_pt, tips / nullif(n, 0) AS tips_pt, 100.0e0 * pay / nullif(fare, 0) AS pay_share,
  100.0e0 * n_cbd / nullif(n, 0) AS cbd_share, 100.0e0 * shared_req / nullif(n, 0) AS shared_pct"""
RATIO_NAMES = list(panel.RATIOS)
_WINDOW = "(d BETWEEN DATE '2024-01-05' AND DATE '2024-12-31' OR d BETWEEN DATE '2025-01-05' AND DATE '2025-12-31')"


@query("ratio_outcomes", f"SELECT service, d, zone, {_RATIOS} FROM zone_day_pu", " ".join(RATIO_NAMES))
def ratio_outcomes(t):
    """The 15 ratio outcomes of each zone and day, from sums."""
    return panel.add_ratios(t.gold("zone_day_pu")).select("service", "d", "zone", *RATIO_NAMES)


@query(
    "distinct_days",
    "SELECT service, CAST(year(d) AS INTEGER) AS yr, CAST(count(DISTINCT d) AS BIGINT) AS days, CAST(count(DISTINCT zone) AS BIGINT) AS zones"
    " FROM zone_day_pu GROUP BY ALL",
)
def distinct_days(t):
    """Distinct days and zones per service and year."""
    g = t.gold("zone_day_pu")
    return g.groupBy("service", F.year("d").alias("yr")).agg(F.countDistinct("d").alias("days"), F.countDistinct("zone").alias("zones"))


@query(
    "flow_share_change",
    """SELECT pu_grp, do_grp, max(share) FILTER (WHERE yr = 2024) AS share_2024, max(share) FILTER (WHERE yr = 2025) AS share_2025,
         max(share) FILTER (WHERE yr = 2025) - max(share) FILTER (WHERE yr = 2024) AS change_pp
       FROM (SELECT yr, pu_grp, do_grp, 100.0e0 * n / sum(n) OVER (PARTITION BY yr) AS share FROM (
         SELECT year(d) AS yr, pu_grp, do_grp, sum(n) AS n FROM grp_hour_day
         WHERE service = 'hvfhv' AND year(d) IN (2024, 2025) GROUP BY ALL)) GROUP BY ALL""",
    "share_2024 share_2025 change_pp",
)
def flow_share_change(t):
    """Share of trips per flow in each year and its change in points."""
    g = t.gold("grp_hour_day").where("service = 'hvfhv' AND year(d) IN (2024, 2025)")
    flows = g.groupBy(F.year("d").alias("yr"), "pu_grp", "do_grp").agg(F.sum("n").alias("n"))
    totals = flows.groupBy("yr").agg(F.sum("n").alias("total"))
    shares = flows.join(totals, "yr").withColumn("share", 100.0 * ratio("n", "total"))
    wide = reshape.pivot_sum(shares, ["pu_grp", "do_grp"], "yr", [2024, 2025], "share", "share_")
    return wide.withColumn("change_pp", F.col("share_2025") - F.col("share_2024"))


@query(
    "company_share_by_month",
    """SELECT ym, 100.0e0 * coalesce(sum(n) FILTER (WHERE company_code = 'HV0003'), 0) / sum(n) AS HV0003,
         100.0e0 * coalesce(sum(n) FILTER (WHERE company_code = 'HV0005'), 0) / sum(n) AS HV0005
       FROM (SELECT strftime(d, '%Y-%m') AS ym, company_code, n FROM company_grp_day WHERE service = 'hvfhv') GROUP BY ym""",
    "HV0003 HV0005",
)
def company_share_by_month(t):
    """Row-normalised cross-table of months and companies."""
    g = t.gold("company_grp_day").where("service = 'hvfhv'").withColumn("ym", year_month("d"))
    wide = reshape.pivot_sum(g, ["ym"], "company_code", ["HV0003", "HV0005"], "n")
    return reshape.row_shares(wide, ["HV0003", "HV0005"])


@query(
    "quantiles_by_group",
    """SELECT touch_crz, yr, prob, quantile_cont(rider_cost, prob) AS value FROM (
         SELECT touch_crz, CAST(year(d) AS INTEGER) AS yr, rider_cost FROM silver WHERE service = 'hvfhv')
       CROSS JOIN (SELECT unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0]) AS prob) GROUP BY touch_crz, yr, prob""".replace(
        "quantile_cont(rider_cost, prob)",
        "CASE prob WHEN 0.1e0 THEN quantile_cont(rider_cost, 0.1) WHEN 0.25e0 THEN quantile_cont(rider_cost, 0.25)"
        " WHEN 0.5e0 THEN quantile_cont(rider_cost, 0.5) WHEN 0.75e0 THEN quantile_cont(rider_cost, 0.75) ELSE quantile_cont(rider_cost, 0.9) END",
    ),
    "value",
)
def quantiles_by_group(t):
    """Quantiles of what riders pay, per group and year."""
    s = t.trips.where("service = 'hvfhv'").withColumn("yr", F.year("d"))
    return reshape.exact_quantiles(s, ["touch_crz", "yr"], "rider_cost", [0.1, 0.25, 0.5, 0.75, 0.9])


@query(
    "median_profile",
    "SELECT flagged, metric, median(v) AS value FROM (UNPIVOT (SELECT CAST(fare > 500 AS INTEGER) AS flagged, miles, time_s, fare, mph FROM silver)"
    " ON miles, time_s, fare, mph INTO NAME metric VALUE v) GROUP BY ALL",
    "value",
)
def median_profile(t):
    """Median of several trip measures for marked and other trips."""
    s = t.trips.select((F.col("fare") > 500).cast("int").alias("flagged"), "miles", "time_s", "fare", "mph")
    long = s.unpivot(["flagged"], ["miles", "time_s", "fare", "mph"], "metric", "v")
    return reshape.exact_quantiles(long, ["flagged", "metric"], "v", [0.5]).select("flagged", "metric", "value")


@query(
    "source_summary",
    "SELECT service, CAST(count(*) AS BIGINT) AS n_rows, min(pickup_ts) AS first_pickup, max(pickup_ts) AS last_pickup, sum(fare) AS fare_sum,"
    " avg(fare) AS fare_mean, min(fare) AS fare_min, max(fare) AS fare_max, stddev_samp(fare) AS fare_sd FROM trips GROUP BY service",
    "fare_sum:2 fare_mean fare_min fare_max fare_sd",
)
def source_summary(t):
    """Rows, time range and fare statistics per source."""
    return t.two_sources.groupBy("service").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("pickup_ts").alias("first_pickup"),
        F.max("pickup_ts").alias("last_pickup"),
        F.sum("fare").alias("fare_sum"),
        F.avg("fare").alias("fare_mean"),
        F.min("fare").alias("fare_min"),
        F.max("fare").alias("fare_max"),
        F.stddev_samp("fare").alias("fare_sd"),
    )


_DESC = "trips:4 fare:4 pay:4 miles:4 time_s:4 trips_per_day fare_per_trip pay_per_trip miles_per_trip min_per_trip mph wait_min cbd_per_trip tips_per_trip"


@query(
    "desc_group_year",
    """SELECT service, grp, yr, trips, fare, pay, miles, time_s, trips / days AS trips_per_day, fare / trips AS fare_per_trip,
         pay / trips AS pay_per_trip, miles / trips AS miles_per_trip, time_s / trips / 60 AS min_per_trip, miles / (time_s / 3600) AS mph,
         wait_sum / nullif(wait_n, 0) AS wait_min, cbd / trips AS cbd_per_trip, tips / trips AS tips_per_trip
       FROM (SELECT service, grp, CAST(year(d) AS INTEGER) AS yr, CAST(sum(n) AS DOUBLE) AS trips, sum(fare) AS fare, sum(pay) AS pay, sum(miles) AS miles,
               sum(time_s) AS time_s, sum(wait_sum) AS wait_sum, sum(wait_n) AS wait_n, sum(cbd) AS cbd, sum(tips) AS tips
             FROM zone_day_pu JOIN dim_zone USING (zone) GROUP BY ALL)
       JOIN (SELECT year(d) AS yr, count(DISTINCT d) AS days FROM zone_day_pu GROUP BY 1) USING (yr)""",
    _DESC,
)
def desc_group_year(t):
    """Trips per day, per-trip figures and speed by zone group and year."""
    g = t.gold("zone_day_pu").withColumn("yr", F.year("d"))
    days = g.groupBy("yr").agg(F.countDistinct("d").alias("days"))
    s = gold.sum_measures(g.join(t.dim_zone.select("zone", "grp"), "zone"), ["service", "grp", "yr"]).join(days, "yr")
    return s.select(
        "service", "grp", "yr", F.col("n").cast("double").alias("trips"), "fare", "pay", "miles", "time_s",
        ratio("n", "days").alias("trips_per_day"),
        ratio("fare", "n").alias("fare_per_trip"),
        ratio("pay", "n").alias("pay_per_trip"),
        ratio("miles", "n").alias("miles_per_trip"),
        (ratio("time_s", "n") / 60).alias("min_per_trip"),
        ratio("miles", F.col("time_s") / HOUR).alias("mph"),
        ratio("wait_sum", "wait_n").alias("wait_min"),
        ratio("cbd", "n").alias("cbd_per_trip"),
        ratio("tips", "n").alias("tips_per_trip"),
    )


_ZD_PARTS = {
    "zd_days": f"SELECT year(d) AS yr, count(DISTINCT d) AS days FROM zone_day_pu WHERE {_WINDOW} GROUP BY 1",
    "zd_pu": f"""SELECT service, zone, year(d) AS yr, sum(n) AS n, sum(fare) AS fare, sum(miles) AS miles, sum(time_s) AS time_s,
        sum(n_to_crz) AS n_to_crz FROM zone_day_pu WHERE {_WINDOW} GROUP BY ALL""",
    "zd_do": f"SELECT service, zone, year(d) AS yr, sum(n) AS n_do FROM zone_day_do WHERE {_WINDOW} GROUP BY ALL",
    "zd_all": """SELECT service, zone, yr, n / days AS pu_day, n_do / days AS do_day, fare / nullif(n, 0) AS fare_pt,
        miles / nullif(time_s / 3600.0e0, 0) AS mph, 100.0e0 * n_to_crz / nullif(n, 0) AS share
        FROM (SELECT * FROM zd_pu FULL JOIN zd_do USING (service, zone, yr)) JOIN zd_days USING (yr)""",
}
_ZD_COLS = ("pu_day", "do_day", "fare_pt", "mph", "share")
_ZD_WIDE = ", ".join(f"max({c}) FILTER (WHERE yr = {y}) AS {c}_{y}" for c in _ZD_COLS for y in (2024, 2025))


@query(
    "zone_detail",
    f"""SELECT w.*, grp, borough, 100.0e0 * (pu_day_2025 / pu_day_2024 - 1) AS pu_yoy_pct, 100.0e0 * (do_day_2025 / do_day_2024 - 1) AS do_yoy_pct
        FROM (SELECT service, zone, {_ZD_WIDE} FROM zd_all GROUP BY ALL) AS w LEFT JOIN dim_zone USING (zone)""",
    " ".join(f"{c}_{y}" for c in _ZD_COLS for y in (2024, 2025)) + " pu_yoy_pct do_yoy_pct",
    _ZD_PARTS,
)
def zone_detail(t):
    """Pick-ups and drop-offs per day and year side by side for each zone."""
    pu = t.gold("zone_day_pu").where(clean.same_window()).withColumn("yr", F.year("d"))
    do = t.gold("zone_day_do").where(clean.same_window()).withColumn("yr", F.year("d"))
    keys = ["service", "zone", "yr"]
    days = pu.groupBy("yr").agg(F.countDistinct("d").alias("days"))
    a = gold.sum_measures(pu, keys, ["n", "fare", "miles", "time_s", "n_to_crz"])
    b = do.groupBy(*keys).agg(F.sum("n").alias("n_do"))
    m = a.join(b, keys, "full_outer").join(days, "yr")
    m = m.select(
        *keys,
        ratio("n", "days").alias("pu_day"),
        ratio("n_do", "days").alias("do_day"),
        ratio("fare", "n").alias("fare_pt"),
        ratio("miles", F.col("time_s") / HOUR).alias("mph"),
        (100.0 * ratio("n_to_crz", "n")).alias("share"),
    )
    wide = m.groupBy("service", "zone").agg(
        *[F.max(F.when(F.col("yr") == y, F.col(c))).alias(f"{c}_{y}") for c in _ZD_COLS for y in (2024, 2025)]
    )
    out = wide.join(t.dim_zone.select("zone", "grp", "borough"), "zone", "left")
    return out.withColumns(
        {f"{c}_yoy_pct": 100.0 * (ratio(f"{c}_day_2025", f"{c}_day_2024") - 1) for c in ("pu", "do")}
    )


@query(
    "month_group_detail",
    """SELECT service, ym, grp, sum(n) / any_value(days) AS trips_per_day, sum(fare) / sum(n) AS fare_pt, sum(pay) / sum(n) AS pay_pt,
         sum(miles) / (sum(time_s) / 3600.0e0) AS mph, sum(wait_sum) / nullif(sum(wait_n), 0) AS wait, sum(cbd) / sum(n) AS cbd_pt,
         100.0e0 * sum(n_cbd) / sum(n) AS share_cbd
       FROM (SELECT *, strftime(d, '%Y-%m') AS ym FROM zone_day_pu) JOIN dim_zone USING (zone)
       JOIN (SELECT strftime(d, '%Y-%m') AS ym, count(DISTINCT d) AS days FROM zone_day_pu GROUP BY 1) USING (ym) GROUP BY service, ym, grp""",
    "trips_per_day fare_pt pay_pt mph wait cbd_pt share_cbd",
)
def month_group_detail(t):
    """Per-trip figures by service, month and zone group."""
    z = t.gold("zone_day_pu").withColumn("ym", year_month("d"))
    days = z.groupBy("ym").agg(F.countDistinct("d").alias("days"))
    g = gold.sum_measures(z.join(t.dim_zone.select("zone", "grp"), "zone"), ["service", "ym", "grp"]).join(days, "ym")
    return g.select(
        "service", "ym", "grp",
        ratio("n", "days").alias("trips_per_day"),
        ratio("fare", "n").alias("fare_pt"),
        ratio("pay", "n").alias("pay_pt"),
        ratio("miles", F.col("time_s") / HOUR).alias("mph"),
        ratio("wait_sum", "wait_n").alias("wait"),
        ratio("cbd", "n").alias("cbd_pt"),
        (100.0 * ratio("n_cbd", "n")).alias("share_cbd"),
    )


@query(
    "flow_hour_detail",
    f"""SELECT service, pu_grp, do_grp, hr, CAST(yr AS INTEGER) AS yr, n / days AS per_day, miles / nullif(time_s / 3600.0e0, 0) AS mph, fare / n AS fare_pt
        FROM (SELECT service, pu_grp, do_grp, hr, year(d) AS yr, sum(n) AS n, sum(miles) AS miles, sum(time_s) AS time_s, sum(fare) AS fare
              FROM grp_hour_day WHERE {_WINDOW} GROUP BY ALL)
        JOIN (SELECT year(d) AS yr, count(DISTINCT d) AS days FROM grp_hour_day WHERE {_WINDOW} GROUP BY 1) USING (yr)""",
    "per_day mph fare_pt",
)
def flow_hour_detail(t):
    """Trips per day, speed and fare by flow, hour and year over the same calendar window."""
    g = t.gold("grp_hour_day").where(clean.same_window()).withColumn("yr", F.year("d"))
    days = g.groupBy("yr").agg(F.countDistinct("d").alias("days"))
    s = gold.sum_measures(g, ["service", "pu_grp", "do_grp", "hr", "yr"], ["n", "miles", "time_s", "fare"]).join(days, "yr")
    return s.select(
        "service", "pu_grp", "do_grp", "hr", "yr",
        ratio("n", "days").alias("per_day"),
        ratio("miles", F.col("time_s") / HOUR).alias("mph"),
        ratio("fare", "n").alias("fare_pt"),
    )


@query(
    "fee_revenue_month",
    """SELECT service, strftime(d, '%Y-%m') AS ym, sum(cbd) AS cbd, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_cbd) AS BIGINT) AS n_cbd,
         100.0e0 * sum(n_cbd) / sum(n) AS share_charged, sum(cbd) / nullif(sum(n_cbd), 0) AS avg_fee_charged
       FROM zone_day_pu WHERE d >= DATE '2025-01-05' GROUP BY ALL""",
    "cbd:4 share_charged avg_fee_charged",
)
def fee_revenue_month(t):
    """Fee revenue, share of charged trips and mean fee by month."""
    z = t.gold("zone_day_pu").where("d >= DATE'2025-01-05'")
    g = gold.sum_measures(z, ["service", year_month("d").alias("ym")], ["cbd", "n", "n_cbd"])
    return g.withColumns({"share_charged": 100.0 * ratio("n_cbd", "n"), "avg_fee_charged": ratio("cbd", "n_cbd")})


@query(
    "price_pay_month",
    """SELECT strftime(d, '%Y-%m') AS ym, CASE WHEN pu_grp = 'CRZ' OR do_grp = 'CRZ' THEN 'touch' ELSE 'no_touch' END AS flow,
         sum(fare) / sum(n) AS fare_per_trip, sum(pay) / sum(n) AS pay_per_trip, sum(fare) / sum(miles) AS fare_per_mile, sum(pay) / sum(miles) AS pay_per_mile,
         sum(rider_cost) / sum(n) AS rider_cost_per_trip, 100.0e0 * sum(pay) / sum(fare) AS pay_share, sum(wait_sum) / nullif(sum(wait_n), 0) AS wait_min
       FROM grp_hour_day WHERE service = 'hvfhv' AND (pu_grp = 'CRZ' OR do_grp = 'CRZ' OR (pu_grp IN ('MN_NORTH', 'OUTER') AND do_grp IN ('MN_NORTH', 'OUTER')))
       GROUP BY ALL""",
    "fare_per_trip pay_per_trip fare_per_mile pay_per_mile rider_cost_per_trip pay_share wait_min",
)
def price_pay_month(t):
    """Prices and driver pay by month, for flows that touch the treated area and those that do not."""
    g = t.gold("grp_hour_day").where("service = 'hvfhv'")
    touch = (F.col("pu_grp") == "CRZ") | (F.col("do_grp") == "CRZ")
    outside = F.col("pu_grp").isin("MN_NORTH", "OUTER") & F.col("do_grp").isin("MN_NORTH", "OUTER")
    flow = F.when(touch, "touch").otherwise("no_touch").alias("flow")
    s = gold.sum_measures(g.where(touch | outside), [year_month("d").alias("ym"), flow])
    return s.select(
        "ym", "flow",
        ratio("fare", "n").alias("fare_per_trip"),
        ratio("pay", "n").alias("pay_per_trip"),
        ratio("fare", "miles").alias("fare_per_mile"),
        ratio("pay", "miles").alias("pay_per_mile"),
        ratio("rider_cost", "n").alias("rider_cost_per_trip"),
        (100.0 * ratio("pay", "fare")).alias("pay_share"),
        ratio("wait_sum", "wait_n").alias("wait_min"),
    )


@query(
    "airport_flows",
    f"""SELECT pu_grp, do_grp, sum(n) FILTER (WHERE yr = 2024) / any_value(d24) AS y2024, sum(n) FILTER (WHERE yr = 2025) / any_value(d25) AS y2025,
          100.0e0 * ((sum(n) FILTER (WHERE yr = 2025) / any_value(d25)) / (sum(n) FILTER (WHERE yr = 2024) / any_value(d24)) - 1) AS yoy_pct
        FROM (SELECT *, year(d) AS yr FROM grp_hour_day WHERE service = 'hvfhv' AND {_WINDOW} AND (pu_grp = 'AIRPORT' OR do_grp = 'AIRPORT'))
        CROSS JOIN (SELECT count(DISTINCT d) FILTER (WHERE year(d) = 2024) AS d24, count(DISTINCT d) FILTER (WHERE year(d) = 2025) AS d25
                    FROM grp_hour_day WHERE service = 'hvfhv' AND {_WINDOW}) GROUP BY ALL""",
    "y2024 y2025 yoy_pct",
)
def airport_flows(t):
    """Airport trips per day in both years and the change."""
    g = t.gold("grp_hour_day").where("service = 'hvfhv'").where(clean.same_window()).withColumn("yr", F.year("d"))
    days = g.groupBy("yr").agg(F.countDistinct("d").alias("days"))
    air = g.where("pu_grp = 'AIRPORT' OR do_grp = 'AIRPORT'").groupBy("pu_grp", "do_grp", "yr").agg(F.sum("n").alias("n"))
    return timeops.year_over_year(air.join(days, "yr").withColumn("x", ratio("n", "days")), ["pu_grp", "do_grp"], "x")


_MBINS = {"m1": "<1", "m2": "1-2", "m3": "2-3", "m5": "3-5", "m10": "5-10", "m99": ">10"}
_MBIN_SQL = " ".join(f"WHEN miles < {k[1:]} THEN '{k}'" for k in list(_MBINS)[:-1])


@query(
    "distance_composition",
    f"""SELECT touch_crz, CAST(year(d) AS INTEGER) AS yr, """
    + ", ".join(f"100.0e0 * count(*) FILTER (WHERE b = '{k}') / count(*) AS {k}" for k in _MBINS)
    + f" FROM (SELECT *, CASE {_MBIN_SQL} ELSE 'm99' END AS b FROM silver WHERE service = 'hvfhv' AND {_WINDOW}) GROUP BY ALL",
    " ".join(_MBINS),
)
def distance_composition(t):
    """Percent of trips per distance bin."""
    s = t.trips.where("service = 'hvfhv'").where(clean.same_window())
    counts = s.groupBy("touch_crz", F.year("d").alias("yr"), clean.distance_bin().alias("b")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.replace({v: k for k, v in _MBINS.items()}, subset=["b"])
    wide = reshape.pivot_sum(named, ["touch_crz", "yr"], "b", list(_MBINS), "n")
    return reshape.row_shares(wide, list(_MBINS))


_GROUPS = ["AIRPORT", "CRZ", "CRZ_PARTIAL", "MN_NORTH", "OUTER"]


@query(
    "flow_matrix",
    "SELECT CAST(year(d) AS INTEGER) AS yr, pu_grp, "
    + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE do_grp = '{g}'), 0) AS BIGINT) AS {g}" for g in _GROUPS)
    + " FROM grp_hour_day WHERE service = 'hvfhv' GROUP BY ALL",
)
def flow_matrix(t):
    """Trips from origin group to destination group, by year."""
    g = t.gold("grp_hour_day").where("service = 'hvfhv'").withColumn("yr", F.year("d"))
    return reshape.pivot_sum(g, ["yr", "pu_grp"], "do_grp", _GROUPS, "n").fillna(0, _GROUPS)


# ------------------------------------------------------------------ windows and calendar
_DAILY = {
    "daily_grp": "SELECT d, grp, CAST(sum(n) AS DOUBLE) AS n FROM zone_day_pu JOIN dim_zone USING (zone) GROUP BY ALL",
}


def daily_by_group(t):
    z = t.gold("zone_day_pu").join(t.dim_zone.select("zone", "grp"), "zone")
    return z.groupBy("d", "grp").agg(F.sum("n").cast("double").alias("n"))


@query(
    "moving_avg_7d",
    """SELECT d, grp, n, CASE WHEN count(n) OVER w = 7 THEN avg(n) OVER w END AS ma FROM daily_grp
       WINDOW w AS (PARTITION BY grp ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "n:4 ma",
    _DAILY,
)
def moving_avg_7d(t):
    """Centred 7-day moving average of daily trips."""
    return timeops.moving_average(daily_by_group(t), "n", ["grp"], "d")


@query(
    "naive_lag7",
    "SELECT d, grp, n, lag(n, 7) OVER (PARTITION BY grp ORDER BY d) AS n_lag7 FROM daily_grp",
    "n:4 n_lag7:4",
    _DAILY,
)
def naive_lag7(t):
    """Value seven rows earlier: the weekly naive forecast."""
    return timeops.lag_rows(daily_by_group(t), "n", ["grp"], "d", 7, "n_lag7")


_ROBUST = {
    "daily_svc": """SELECT service, pu_grp AS grp, d, CAST(sum(n) AS DOUBLE) AS n FROM grp_hour_day
        WHERE pu_grp IN ('CRZ', 'MN_NORTH', 'OUTER', 'AIRPORT') GROUP BY ALL""",
    "win_med": """SELECT a.service, a.grp, a.d, a.n, median(ln(b.n)) AS expected_log FROM daily_svc AS a LEFT JOIN daily_svc AS b
        ON a.service = b.service AND a.grp = b.grp AND isodow(a.d) = isodow(b.d) AND b.d BETWEEN a.d - 28 AND a.d + 28 AND a.d <> b.d GROUP BY ALL""",
    "win_mad": """SELECT a.service, a.grp, a.d, a.n, a.expected_log, 1.4826e0 * median(abs(ln(b.n) - a.expected_log)) AS mad FROM win_med AS a LEFT JOIN daily_svc AS b
        ON a.service = b.service AND a.grp = b.grp AND isodow(a.d) = isodow(b.d) AND b.d BETWEEN a.d - 28 AND a.d + 28 AND a.d <> b.d GROUP BY ALL""",
    "scored": """SELECT *, (ln(n) - expected_log) / nullif(mad, 0) AS z, 100.0e0 * (exp(ln(n) - expected_log) - 1) AS dev_pct FROM win_mad""",
}


def daily_by_service(t):
    g = t.gold("grp_hour_day").where("pu_grp IN ('CRZ', 'MN_NORTH', 'OUTER', 'AIRPORT')")
    return g.groupBy("service", F.col("pu_grp").alias("grp"), "d").agg(F.sum("n").cast("double").alias("n"))


@query(
    "robust_daily_anomaly",
    "SELECT *, CASE WHEN abs(z) > 3.5 THEN 1 ELSE 0 END AS flag FROM scored",
    "n:4 expected_log mad z:5 dev_pct:5",
    _ROBUST,
)
def robust_daily_anomaly(t):
    """Robust z-score of each day against the same weekday nearby."""
    return timeops.robust_anomaly(daily_by_service(t), ["service", "grp"])


@query(
    "anomaly_summary",
    """SELECT service, grp, CAST(count(*) AS BIGINT) AS days, CAST(count(*) FILTER (WHERE abs(z) > 3.5) AS BIGINT) AS flagged,
       CAST(count(*) FILTER (WHERE z < -3.5) AS BIGINT) AS flagged_low, CAST(count(*) FILTER (WHERE z > 3.5) AS BIGINT) AS flagged_high
       FROM scored GROUP BY ALL""",
    "",
    _ROBUST,
)
def anomaly_summary(t):
    """Days flagged low and high per series."""
    return timeops.anomaly_summary(timeops.robust_anomaly(daily_by_service(t), ["service", "grp"]), ["service", "grp"])


@query(
    "index_base100",
    "SELECT d, grp, n, 100.0e0 * n / avg(n) FILTER (WHERE year(d) = 2024) OVER (PARTITION BY grp) AS idx FROM daily_grp",
    "n:4 idx",
    _DAILY,
)
def index_base100(t):
    """Daily trips as percent of the 2024 mean."""
    return timeops.index_to_base(daily_by_group(t), "n", ["grp"], F.year("d") == 2024)


@query(
    "yoy_iso_week",
    """SELECT grp, w, sum(n) FILTER (WHERE y = 2024) AS y2024, sum(n) FILTER (WHERE y = 2025) AS y2025,
         100.0e0 * (sum(n) FILTER (WHERE y = 2025) / sum(n) FILTER (WHERE y = 2024) - 1) AS yoy_pct
       FROM (SELECT grp, CAST(week(d) AS INTEGER) AS w, isoyear(d) AS y, n FROM daily_grp) WHERE w BETWEEN 2 AND 51 GROUP BY ALL""",
    "y2024:4 y2025:4 yoy_pct",
    _DAILY,
)
def yoy_iso_week(t):
    """Year-on-year change by ISO week 2 to 51."""
    w = daily_by_group(t).withColumns({"w": F.weekofyear("d"), "yr": F.expr("extract(YEAROFWEEK FROM d)")})
    return timeops.year_over_year(w.where("w BETWEEN 2 AND 51"), ["grp", "w"], "n")


@query(
    "yoy_by_zone",
    """SELECT zone, grp, y2024, y2025, 100.0e0 * (y2025 / y2024 - 1) AS yoy_pct FROM (
         SELECT zone, CAST(sum(n) FILTER (WHERE year(d) = 2024) AS DOUBLE) AS y2024, CAST(sum(n) FILTER (WHERE year(d) = 2025) AS DOUBLE) AS y2025
         FROM zone_day_pu WHERE service = 'hvfhv' AND dayofyear(d) >= 5 GROUP BY zone) LEFT JOIN dim_zone USING (zone) WHERE y2024 >= 50""",
    "y2024:4 y2025:4 yoy_pct",
)
def yoy_by_zone(t):
    """Year-on-year change per zone with a volume floor."""
    z = t.gold("zone_day_pu").where("service = 'hvfhv' AND dayofyear(d) >= 5").withColumn("yr", F.year("d"))
    yoy = timeops.year_over_year(z, ["zone"], "n").where("y2024 >= 50")
    return yoy.join(t.dim_zone.select("zone", "grp"), "zone", "left").select("zone", "grp", "y2024", "y2025", "yoy_pct")


@query(
    "sunday_week",
    "SELECT d - CAST(dayofweek(d) AS INTEGER) AS wk, zone, CAST(sum(n) AS BIGINT) AS n FROM zone_day_pu GROUP BY ALL",
)
def sunday_week(t):
    """Trips per zone and week that starts on Sunday."""
    return t.gold("zone_day_pu").groupBy(exprs.sunday_week("d").alias("wk"), "zone").agg(F.sum("n").alias("n"))


@query(
    "weekly_resample",
    """SELECT a.grp, a.w_sun, a.n_sum, b.n_mean FROM
        (SELECT grp, d + CAST((7 - isodow(d)) % 7 AS INTEGER) AS w_sun, sum(n) AS n_sum FROM daily_grp GROUP BY ALL) AS a
        LEFT JOIN (SELECT grp, d + CAST((6 - isodow(d) + 7) % 7 AS INTEGER) AS w_sat, avg(n) AS n_mean FROM daily_grp GROUP BY ALL) AS b
        ON a.grp = b.grp AND a.w_sun = b.w_sat + 1""",
    "n_sum:4 n_mean",
    _DAILY,
)
def weekly_resample(t):
    """Weekly sums (weeks end on Sunday) and weekly means (weeks end on Saturday)."""
    daily = daily_by_group(t)
    sums = daily.groupBy("grp", week_ending("d", 7).alias("w_sun")).agg(F.sum("n").alias("n_sum"))
    means = daily.groupBy("grp", F.date_add(week_ending("d", 6), 1).alias("w_sun")).agg(F.avg("n").alias("n_mean"))
    return sums.join(means, ["grp", "w_sun"], "left")


@query(
    "relative_time",
    """SELECT DISTINCT d, CAST(floor(date_diff('day', DATE '2025-01-05', d) / 7.0) AS INTEGER) AS k,
         CAST((year(d) - 2025) * 12 + month(d) - 1 AS INTEGER) AS km,
         CAST((floor(date_diff('day', DATE '2024-01-07', d) / 7.0) % 52 + 52) % 52 AS INTEGER) AS woy,
         CAST(week(d) AS INTEGER) AS iso_week, CAST(month(d) AS INTEGER) AS moy FROM zone_day_pu""",
)
def relative_time(t):
    """Week and month distance to the policy date and two week numbers."""
    return timeops.relative_periods(t.gold("zone_day_pu").select("d").distinct(), "d")


@query(
    "hour_profile",
    """SELECT hr, sum(n) FILTER (WHERE yr = 2024) / any_value(d24) AS y2024, sum(n) FILTER (WHERE yr = 2025) / any_value(d25) AS y2025
       FROM (SELECT *, year(d) AS yr FROM grp_hour_day WHERE service = 'hvfhv' AND (pu_grp = 'CRZ' OR do_grp = 'CRZ'))
       CROSS JOIN (SELECT count(DISTINCT d) FILTER (WHERE year(d) = 2024) AS d24, count(DISTINCT d) FILTER (WHERE year(d) = 2025) AS d25
                   FROM grp_hour_day WHERE service = 'hvfhv') GROUP BY hr""",
    "y2024 y2025",
)
def hour_profile(t):
    """Trips per hour and day that touch the treated area, by year."""
    g = t.gold("grp_hour_day").where("service = 'hvfhv'").withColumn("yr", F.year("d"))
    days = g.groupBy("yr").agg(F.countDistinct("d").alias("days"))
    touch = g.where("pu_grp = 'CRZ' OR do_grp = 'CRZ'").groupBy("hr", "yr").agg(F.sum("n").alias("n")).join(days, "yr")
    return reshape.pivot_sum(touch.withColumn("x", ratio("n", "days")), ["hr"], "yr", [2024, 2025], "x", "y")


@query(
    "speed_by_hour",
    """SELECT pu_grp AS grp, hr, CAST(year(d) AS INTEGER) AS yr, sum(miles) / nullif(sum(time_s) / 3600.0e0, 0) AS mph
       FROM grp_hour_day WHERE service = 'hvfhv' AND pu_grp = do_grp AND pu_grp IN ('CRZ', 'MN_NORTH', 'OUTER') GROUP BY ALL""",
    "mph",
)
def speed_by_hour(t):
    """Speed inside a zone group by hour and year, from sums."""
    g = t.gold("grp_hour_day").where("service = 'hvfhv' AND pu_grp = do_grp AND pu_grp IN ('CRZ', 'MN_NORTH', 'OUTER')")
    s = gold.sum_measures(g, [F.col("pu_grp").alias("grp"), "hr", F.year("d").alias("yr")], ["miles", "time_s"])
    return s.select("grp", "hr", "yr", ratio("miles", F.col("time_s") / HOUR).alias("mph"))


@query(
    "speed_by_month",
    """SELECT pu_grp AS grp, strftime(d, '%Y-%m') AS ym, sum(miles) / nullif(sum(time_s) / 3600.0e0, 0) AS mph
       FROM grp_hour_day WHERE service = 'hvfhv' AND pu_grp = do_grp AND pu_grp IN ('CRZ', 'MN_NORTH', 'OUTER') GROUP BY ALL""",
    "mph",
)
def speed_by_month(t):
    """Speed inside a zone group by month."""
    g = t.gold("grp_hour_day").where("service = 'hvfhv' AND pu_grp = do_grp AND pu_grp IN ('CRZ', 'MN_NORTH', 'OUTER')")
    s = gold.sum_measures(g, [F.col("pu_grp").alias("grp"), year_month("d").alias("ym")], ["miles", "time_s"])
    return s.select("grp", "ym", ratio("miles", F.col("time_s") / HOUR).alias("mph"))


def speed_did(t):
    g = t.gold("grp_hour_day").where("service = 'hvfhv' AND pu_grp = do_grp AND pu_grp IN ('CRZ', 'MN_NORTH', 'OUTER')")
    g = g.where(clean.same_window()).withColumns(
        {"yr": F.year("d"), "daytype": F.when(F.weekday("d") >= 5, "weekend").otherwise("weekday")}
    )
    s = gold.sum_measures(g, ["pu_grp", "daytype", "hr", "yr"], ["miles", "time_s"])
    s = s.withColumn("mph", ratio("miles", F.col("time_s") / HOUR))
    diff = reshape.pivot_sum(s, ["pu_grp", "daytype", "hr"], "yr", [2024, 2025], "mph", "y")
    diff = diff.withColumn("chg", F.col("y2025") - F.col("y2024"))
    wide = reshape.pivot_sum(diff, ["daytype", "hr"], "pu_grp", ["CRZ", "MN_NORTH", "OUTER"], "chg")
    return wide.withColumns({"did_vs_outer": F.col("CRZ") - F.col("OUTER"), "did_vs_mn": F.col("CRZ") - F.col("MN_NORTH")})


SPEED_DID = {
    "speed_cells": f"""SELECT pu_grp, CASE WHEN isodow(d) >= 6 THEN 'weekend' ELSE 'weekday' END AS daytype, hr, year(d) AS yr,
        sum(miles) / nullif(sum(time_s) / 3600.0e0, 0) AS mph FROM grp_hour_day
        WHERE service = 'hvfhv' AND pu_grp = do_grp AND pu_grp IN ('CRZ', 'MN_NORTH', 'OUTER') AND {_WINDOW} GROUP BY ALL""",
    "speed_chg": """SELECT pu_grp, daytype, hr, max(mph) FILTER (WHERE yr = 2025) - max(mph) FILTER (WHERE yr = 2024) AS chg FROM speed_cells GROUP BY ALL""",
    "speed_did": """SELECT daytype, hr, max(chg) FILTER (WHERE pu_grp = 'CRZ') AS CRZ, max(chg) FILTER (WHERE pu_grp = 'MN_NORTH') AS MN_NORTH,
        max(chg) FILTER (WHERE pu_grp = 'OUTER') AS "OUTER", max(chg) FILTER (WHERE pu_grp = 'CRZ') - max(chg) FILTER (WHERE pu_grp = 'OUTER') AS did_vs_outer,
        max(chg) FILTER (WHERE pu_grp = 'CRZ') - max(chg) FILTER (WHERE pu_grp = 'MN_NORTH') AS did_vs_mn FROM speed_chg GROUP BY ALL""",
}


@query("speed_did_hour", "SELECT * FROM speed_did", "CRZ MN_NORTH OUTER did_vs_outer did_vs_mn", SPEED_DID)
def speed_did_hour(t):
    """Change in speed by hour and day type, treated against the other groups."""
    return speed_did(t)


_HOL = {
    "hol_years": "SELECT unnest(range(2021, 2028)) AS y",
    "hol_fixed": """SELECT CASE isodow(h) WHEN 6 THEN h - 1 WHEN 7 THEN h + 1 ELSE h END AS h FROM (
        SELECT unnest([make_date(y, 1, 1), make_date(y, 6, 19), make_date(y, 7, 4), make_date(y, 11, 11), make_date(y, 12, 25)]) AS h FROM hol_years)""",
    "hol_floating": """SELECT unnest([
          make_date(y, 1, 1) + CAST((1 - isodow(make_date(y, 1, 1)) + 7) % 7 + 14 AS INTEGER),
          make_date(y, 2, 1) + CAST((1 - isodow(make_date(y, 2, 1)) + 7) % 7 + 14 AS INTEGER),
          make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER),
          make_date(y, 9, 1) + CAST((1 - isodow(make_date(y, 9, 1)) + 7) % 7 AS INTEGER),
          make_date(y, 10, 1) + CAST((1 - isodow(make_date(y, 10, 1)) + 7) % 7 + 7 AS INTEGER),
          make_date(y, 11, 1) + CAST((4 - isodow(make_date(y, 11, 1)) + 7) % 7 + 21 AS INTEGER)]) AS h FROM hol_years""",
    "hol": "SELECT h FROM hol_fixed UNION SELECT h FROM hol_floating",
}


@query(
    "calendar_features",
    "SELECT d, "
    + ", ".join(f"CAST(isodow(d) = {k + 1} AS INTEGER) AS dow{k}" for k in range(6))
    + """, CAST(d IN (SELECT h FROM hol) AS INTEGER) AS holiday,
         CAST(d IN (SELECT h + 1 FROM hol) OR d IN (SELECT h - 1 FROM hol) AS INTEGER) AS hol_adj,
         CAST(month(d) * 100 + day(d) >= 1220 OR month(d) * 100 + day(d) <= 103 AS INTEGER) AS xmas,
         date_diff('day', DATE '2022-01-01', d) / 365.0e0 AS trend, sin(2 * pi() * dayofyear(d) / 365.25e0) AS sin1, cos(2 * pi() * dayofyear(d) / 365.25e0) AS cos1
       FROM (SELECT DISTINCT d FROM zone_day_pu)""",
    "trend sin1 cos1",
    _HOL,
)
def calendar_features(t):
    """Calendar features of every day with trips."""
    return timeops.calendar_features(t.gold("zone_day_pu").select("d").distinct())


# ------------------------------------------------------------------ order and sampling
@query(
    "topk_donors",
    """SELECT zone, CAST(sum(n) AS BIGINT) AS n FROM zone_day_pu JOIN dim_zone USING (zone) WHERE d < DATE '2025-01-05' AND grp <> 'CRZ'
       GROUP BY zone ORDER BY n DESC, zone LIMIT 10""",
)
def topk_donors(t):
    """The ten untreated zones with most trips before the policy."""
    z = t.gold("zone_day_pu").where("d < DATE'2025-01-05'").join(t.dim_zone.where("grp <> 'CRZ'").select("zone"), "zone")
    return reshape.top_k(z.groupBy("zone").agg(F.sum("n").alias("n")), "n", 10, "zone")


@query(
    "dedup_units",
    """SELECT pu, dl, first_ym, n FROM (SELECT pu, dl, ym AS first_ym, CAST(sum(n) AS BIGINT) AS n,
         row_number() OVER (PARTITION BY pu, dl ORDER BY ym) AS r FROM od_month GROUP BY pu, dl, ym) WHERE r = 1""",
)
def dedup_units(t):
    """The first month of each origin-destination pair."""
    pairs = t.gold("od_month").groupBy("pu", "dl", F.col("ym").alias("first_ym")).agg(F.sum("n").alias("n"))
    return reshape.first_per_key(pairs, ["pu", "dl"], ["first_ym"]).select("pu", "dl", "first_ym", "n")


@query(
    "trip_sample",
    """SELECT service, company_code, pickup_ts, pu, dl, fare FROM silver WHERE
         (CAST('0x' || substr(md5(concat_ws('|', '20250105', strftime(pickup_ts, '%Y-%m-%d %H:%M:%S'), CAST(pu AS VARCHAR), CAST(dl AS VARCHAR), company_code)), 1, 8) AS BIGINT) + 0.5e0)
         / 4294967296.0e0 < CASE WHEN service = 'hvfhv' THEN 0.0025e0 ELSE 0.01e0 END""",
    "fare:4",
)
def trip_sample(t):
    """Bernoulli sample of trips with a rate per service, decided by a hash of the trip."""
    rate = F.when(F.col("service") == "hvfhv", 0.0025).otherwise(0.01)
    keyed = t.silver.withColumn("_ts", F.date_format("pickup_ts", "yyyy-MM-dd HH:mm:ss"))
    picked = reshape.hash_sample(keyed, ["_ts", "pu", "dl", "company_code"], rate, 20250105)
    return picked.select("service", "company_code", "pickup_ts", "pu", "dl", "fare")


@query(
    "qcut_bins",
    """SELECT zone, share, CAST(CASE WHEN share <= e[2] THEN 1 WHEN share <= e[3] THEN 2 WHEN share <= e[4] THEN 3 WHEN share <= e[5] THEN 4 ELSE 5 END AS INTEGER) AS bin
       FROM (SELECT zone, sum(n_to_crz) / CAST(sum(n) AS DOUBLE) AS share FROM zone_day_pu GROUP BY zone)
       CROSS JOIN (SELECT quantile_cont(share, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM (SELECT sum(n_to_crz) / CAST(sum(n) AS DOUBLE) AS share FROM zone_day_pu GROUP BY zone))""",
    "share",
)
def qcut_bins(t):
    """Quintile of each zone's share of trips into the treated area."""
    share = t.gold("zone_day_pu").groupBy("zone").agg(ratio(F.sum("n_to_crz"), F.sum("n")).alias("share"))
    return reshape.qcut(share, "share", 5)
