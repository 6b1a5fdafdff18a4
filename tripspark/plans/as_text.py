"""Date and time columns that registered queries return as text, so that every client compares them alike.

Columns marked ``:time`` are written to the second, the others as days.
"""

AS_TEXT = {
    "did_panel": "wk",
    "panel_day": "d",
    "fe_demean_twoway": "wk",
    "fe_demean_weighted": "wk",
    "ratio_outcomes": "d",
    "source_summary": "first_pickup:time last_pickup:time",
    "moving_avg_7d": "d",
    "naive_lag7": "d",
    "robust_daily_anomaly": "d",
    "index_base100": "d",
    "sunday_week": "wk",
    "weekly_resample": "w_sun",
    "relative_time": "d",
    "calendar_features": "d",
    "trip_sample": "pickup_ts:time",
    "standardize_union": "request_ts:time pickup_ts:time dropoff_ts:time src_month",
    "quality_flags": "src_month",
    "silver_clean": "request_ts:time pickup_ts:time dropoff_ts:time d src_month",
    "gold_zone_day_pu": "d",
    "gold_zone_day_do": "d",
    "gold_grp_hour_day": "d",
    "gold_company_grp_day": "d",
    "gold_consolidate": "d",
    "chunk_by_day_range": "src_month",
    "max_all_columns": "request_ts:time pickup_ts:time dropoff_ts:time d src_month",
    "reconcile_full_outer": "d",
    "reconcile_layers": "src_month",
    "csv_roundtrip": "d",
    "csv_plain_roundtrip": "d",
    "incremental_partitions": "src_month",
    "split_by_day": "day",
    "stream_tumbling_1h": "hour:time",
    "stream_append_closed": "hour:time",
    "stream_restart": "hour:time",
    "stream_late_drop": "hour:time",
    "stream_hour_totals": "hour:time",
}
