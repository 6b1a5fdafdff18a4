"""Cleaning rules at their edges, classifiers and additive tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripspark.operators import clean, gold, quality
from tripspark.sources.trips import COMMON, standardize_ridehail, standardize_taxi, union_sources

T0 = dt.datetime(2024, 5, 10, 8, 30)


def trip(**change):
    row = dict(
        service="hvfhv", company_code="HV0003", request_ts=T0 - dt.timedelta(minutes=5), pickup_ts=T0, dropoff_ts=T0 + dt.timedelta(minutes=10),
        pu=10, dl=20, miles=2.0, time_s=600.0, fare=15.0, tolls=0.0, bcf=0.0, tax=1.0, cong_sur=2.75, airport_fee=0.0, cbd_fee=0.0, tips=1.0,
        driver_pay=10.0, shared_req=0, shared_match=0, wav_req=0, total_amount=None, payment_type=None, src_month=dt.date(2024, 5, 1),
    )
    row.update(change)
    return row


SCHEMA = (
    "service string, company_code string, request_ts timestamp_ntz, pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, pu int, dl int, miles double, time_s double,"
    " fare double, tolls double, bcf double, tax double, cong_sur double, airport_fee double, cbd_fee double, tips double, driver_pay double, shared_req int,"
    " shared_match int, wav_req int, total_amount double, payment_type int, src_month date"
)


def frame(spark, *rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "change, broken",
    [
        ({}, set()),
        ({"miles": 0.0}, {"q_bad_miles"}),
        ({"miles": 100.0, "time_s": 14400.0}, set()),
        ({"miles": 100.01, "time_s": 14400.0}, {"q_bad_miles"}),
        ({"time_s": 59.0, "miles": 0.5}, {"q_bad_time"}),
        ({"time_s": 60.0, "miles": 0.5}, set()),
        ({"time_s": 14401.0}, {"q_bad_time"}),
        ({"fare": 0.0}, {"q_bad_fare"}),
        ({"fare": 1000.0}, set()),
        ({"fare": 1000.01}, {"q_bad_fare"}),
        ({"miles": 80.0, "time_s": 3600.0}, set()),
        ({"miles": 80.1, "time_s": 3600.0}, {"q_bad_speed"}),
        ({"driver_pay": -1.0}, {"q_bad_pay"}),
        ({"driver_pay": None}, {"q_bad_pay"}),
        ({"driver_pay": None, "service": "yellow"}, set()),
        ({"pu": 264}, {"q_bad_zone"}),
        ({"dl": None}, {"q_bad_zone"}),
        ({"pickup_ts": None}, {"q_out_of_month"}),
        ({"miles": None}, {"q_bad_miles"}),
        ({"time_s": None}, {"q_bad_time"}),
        ({"fare": None}, {"q_bad_fare"}),
        ({"pickup_ts": dt.datetime(2024, 5, 31, 23, 59, 59, 999999)}, set()),
        ({"pickup_ts": dt.datetime(2024, 6, 1)}, {"q_out_of_month"}),
        ({"pickup_ts": dt.datetime(2023, 5, 10)}, {"q_out_of_month"}),
    ],
)
def test_rules_at_their_edges(spark, change, broken):
    row = clean.add_quality_flags(frame(spark, trip(**change))).first()
    assert {f for f in clean.FLAGS if row[f] == 1} == broken
    assert all(row[f] in (0, 1) for f in clean.FLAGS)


ZONES = [(10, "CRZ"), (20, "OUTER"), (30, "MN_NORTH")]


def test_kept_plus_rejected_is_raw_and_columns_derive(spark):
    rows = [trip(), trip(miles=0.0, fare=0.0), trip(request_ts=T0 - dt.timedelta(hours=3)), trip(request_ts=None), trip(pu=30, dl=99)]
    flagged = clean.add_quality_flags(frame(spark, *rows))
    c = clean.quality_counts(flagged).first()
    assert (c.n_raw, c.n_rejected, c.n_silver, c.q_bad_miles, c.q_bad_fare) == (5, 1, 4, 1, 1)
    silver = clean.derive_columns(flagged, spark.createDataFrame(ZONES, "zone int, grp string"))
    assert silver.count() == c.n_silver
    first = silver.where("pu = 10 AND wait_min IS NOT NULL").first()
    assert (first.hr, first.dow, first.wait_min, first.mph, first.touch_crz, first.pu_grp, first.do_grp) == (8, 5, 5.0, 12.0, 1, "CRZ", "OUTER")
    assert first.rider_cost == pytest.approx(18.75)
    assert silver.where("wait_min IS NULL").count() == 2
    assert silver.where("dl = 99").first().do_grp is None


def test_second_difference_counts_boundaries(spark):
    from tripspark.functions.exprs import second_diff

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0, 900000), dt.datetime(2024, 1, 1, 0, 0, 2, 100000))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(second_diff("a", "b")).first()[0] == 2


def test_standardise_fills_missing_fee_as_double(spark):
    hail = spark.createDataFrame(
        [("HV0003", T0, T0, T0, 1, 2, 1.0, 600, 9.0, None, 5.0, "Y", "N", "N")],
        "hvfhs_license_num string, request_datetime timestamp_ntz, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID long, DOLocationID long,"
        " trip_miles double, trip_time long, base_passenger_fare double, tolls double, driver_pay double, shared_request_flag string, shared_match_flag string, wav_request_flag string",
    )
    taxi = spark.createDataFrame(
        [(T0, T0 + dt.timedelta(seconds=90), 1, 2, 1.0, 9.0, 12.0, 1, 0.75)],
        "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID long, DOLocationID long, trip_distance double, fare_amount double,"
        " total_amount double, payment_type long, cbd_congestion_fee double",
    )
    both = union_sources(standardize_ridehail(hail), standardize_taxi(taxi))
    assert both.columns == COMMON
    assert dict(both.dtypes)["cbd_fee"] == "double"
    a, b = both.orderBy("service").collect()
    assert (a.cbd_fee, a.tolls, a.shared_req, a.time_s) == (0.0, 0.0, 1, 600.0)
    assert (b.cbd_fee, b.driver_pay, b.request_ts, b.time_s) == (0.75, None, None, 90.0)


def test_gold_tables_agree_and_merge(spark):
    rows = [trip(fare=10.0 + i, pu=10 + 10 * (i % 2), service="hvfhv" if i % 3 else "yellow", driver_pay=5.0 if i % 3 else None,
                 request_ts=T0 if i % 3 else None, pickup_ts=T0 + dt.timedelta(days=i % 4)) for i in range(24)]
    silver = clean.clean_trips(frame(spark, *rows), spark.createDataFrame(ZONES, "zone int, grp string"))
    tables = {n: gold.build_gold(silver, n) for n in gold.TABLES}
    totals = {n: df.agg(F.sum("n"), F.sum("fare"), F.sum("wait_n")).first() for n, df in tables.items()}
    assert len({tuple(v) for v in totals.values()}) == 1
    # no pay and no wait: the sum is NULL, the count 0
    y = gold.sum_measures(tables["zone_day_pu"], ["service"]).where("service = 'yellow'").first()
    assert (y.pay, y.wait_sum, y.wait_n) == (None, None, 0)
    halves = [gold.build_gold(silver.where(c), "zone_day_pu") for c in ("fare < 20", "fare >= 20")]
    merged = gold.consolidate(halves[0].unionByName(halves[1]), "zone_day_pu")
    out = quality.compare_cells(merged, tables["zone_day_pu"], ["service", "d", "zone"], ["n", "fare", "pay", "n_to_crz"], "service")
    assert out.where("null_mismatch > 0 OR max_abs_diff > 1e-9").count() == 0
    assert quality.reconcile_keys(merged, tables["zone_day_pu"], ["service", "d", "zone"]).count() == 0


def test_classifiers(spark):
    from tripspark.config import ZoneRules

    rules = ZoneRules(unknown_zones=(9,), airport_zones=(8,))
    z = spark.createDataFrame(
        [(1, "Manhattan", 0.95), (2, "Manhattan", 0.5), (3, "Manhattan", None), (4, "Queens", 0.05), (8, "Queens", 0.99), (9, "Unknown", None), (5, None, 1.0)],
        "zone int, borough string, fee_share double",
    )
    got = {r.zone: r.grp for r in clean.classify_zones(z, rules=rules).collect()}
    assert got == {1: "CRZ", 2: "CRZ_PARTIAL", 3: "MN_NORTH", 4: "OUTER", 8: "AIRPORT", 9: "UNKNOWN", 5: "UNKNOWN"}
    h = spark.range(24).select(F.col("id").alias("hr"), clean.hour_bin("hr").alias("b")).groupBy("b").count().collect()
    assert {r.b: r["count"] for r in h} == {"00-05": 6, "06-09": 4, "10-15": 6, "16-19": 4, "20-23": 4}
    d = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (9.99,)], "miles double").select(clean.distance_bin()).collect()
    assert [r[0] for r in d] == ["<1", "1-2", ">10", "5-10"]
