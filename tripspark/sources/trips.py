"""Raw trip files of two kinds, brought to one common schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.functions.exprs import flag, second_diff

COMMON = (
    "service company_code request_ts pickup_ts dropoff_ts pu dl miles time_s fare tolls bcf tax cong_sur "
    "airport_fee cbd_fee tips driver_pay shared_req shared_match wav_req total_amount payment_type"
).split()


def _money(df: DataFrame, column: str) -> Column:
    """An optional fee as double, 0 where NULL and 0 where the file predates the column.

    The zero is a double literal: a decimal zero would let a later union round small fees.
    """
    if column not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def _finish(df: DataFrame, columns: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    return df.select(*[columns[name].alias(name) for name in COMMON], *keep)


def standardize_ridehail(df: DataFrame, service: str = "hvfhv", keep: tuple[str, ...] = ()) -> DataFrame:
    """Ride-hail records: request time, driver pay and Y/N flags are present."""
    yes = {name: flag(F.col(f"{name}_flag") == "Y") for name in ("shared_request", "shared_match", "wav_request")}
    columns = {
        "service": F.lit(service),
        "company_code": F.col("hvfhs_license_num"),
        "request_ts": F.col("request_datetime"),
        "pickup_ts": F.col("pickup_datetime"),
        "dropoff_ts": F.col("dropoff_datetime"),
        "pu": F.col("PULocationID").cast("int"),
        "dl": F.col("DOLocationID").cast("int"),
        "miles": F.col("trip_miles").cast("double"),
        "time_s": F.col("trip_time").cast("double"),
        "fare": F.col("base_passenger_fare").cast("double"),
        "tolls": _money(df, "tolls"),
        "bcf": _money(df, "bcf"),
        "tax": _money(df, "sales_tax"),
        "cong_sur": _money(df, "congestion_surcharge"),
        "airport_fee": _money(df, "airport_fee"),
        "cbd_fee": _money(df, "cbd_congestion_fee"),
        "tips": _money(df, "tips"),
        "driver_pay": F.col("driver_pay").cast("double"),
        "shared_req": yes["shared_request"],
        "shared_match": yes["shared_match"],
        "wav_req": yes["wav_request"],
        "total_amount": F.lit(None).cast("double"),
        "payment_type": F.lit(None).cast("int"),
    }
    return _finish(df, columns, keep)


def standardize_taxi(df: DataFrame, service: str = "yellow", company: str = "YELLOW", keep: tuple[str, ...] = ()) -> DataFrame:
    """Taxi records: no request time and no driver pay; the duration comes from the two timestamps."""
    none = F.lit(0)
    columns = {
        "service": F.lit(service),
        "company_code": F.lit(company),
        "request_ts": F.lit(None).cast("timestamp_ntz"),
        "pickup_ts": F.col("tpep_pickup_datetime"),
        "dropoff_ts": F.col("tpep_dropoff_datetime"),
        "pu": F.col("PULocationID").cast("int"),
        "dl": F.col("DOLocationID").cast("int"),
        "miles": F.col("trip_distance").cast("double"),
        "time_s": second_diff("tpep_pickup_datetime", "tpep_dropoff_datetime").cast("double"),
        "fare": F.col("fare_amount").cast("double"),
        "tolls": _money(df, "tolls_amount"),
        "bcf": F.lit(0.0),
        "tax": _money(df, "mta_tax"),
        "cong_sur": _money(df, "congestion_surcharge"),
        "airport_fee": _money(df, "Airport_fee"),
        "cbd_fee": _money(df, "cbd_congestion_fee"),
        "tips": _money(df, "tip_amount"),
        "driver_pay": F.lit(None).cast("double"),
        "shared_req": none,
        "shared_match": none,
        "wav_req": none,
        "total_amount": F.col("total_amount").cast("double"),
        "payment_type": F.col("payment_type").cast("int"),
    }
    return _finish(df, columns, keep)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Union of standardised sources by column name."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
