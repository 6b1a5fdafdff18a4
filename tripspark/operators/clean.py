"""Quality flags, the reject filter, derived trip columns and row classifiers."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.config import CLEANING, GROUPS, ZONES, CleaningRules, Groups, ZoneRules
from tripspark.functions.exprs import flag, iso_dow, second_diff
from tripspark.operators.reshape import exact_quantiles

FLAGS = ("q_out_of_month", "q_bad_zone", "q_bad_miles", "q_bad_time", "q_bad_fare", "q_bad_speed", "q_bad_pay")


def _outside(column: str, low: float, high: float, open_low: bool) -> Column:
    """NULL or out of bounds, as 0/1. ``open_low`` excludes the lower end itself."""
    x = F.col(column)
    below = x <= low if open_low else x < low
    return (x.isNull() | F.coalesce(below, F.lit(True)) | F.coalesce(x > high, F.lit(True))).cast("int")


def add_quality_flags(trips: DataFrame, rules: CleaningRules = CLEANING, month: str = "src_month") -> DataFrame:
    """Seven 0/1 columns, one per rule; a missing value breaks the rule and no flag is ever NULL.

    ``month`` names the date column with the first day of the month of the file a row came from, so
    many monthly files are flagged in one job.
    """
    zone_ok = F.col("pu").between(rules.first_zone, rules.last_zone) & F.col("dl").between(rules.first_zone, rules.last_zone)
    # mph above the limit, without a division that a zero duration would break
    too_fast = (F.col("time_s") > 0) & (F.try_divide(F.col("miles"), F.col("time_s") / 3600.0) > rules.max_speed_mph)
    unpaid = F.col("service").isin(*rules.pay_required) & (F.col("driver_pay").isNull() | (F.col("driver_pay") < 0))
    return trips.withColumns(
        {
            "q_out_of_month": (~F.coalesce(_in_month("pickup_ts", month), F.lit(False))).cast("int"),
            "q_bad_zone": (~F.coalesce(zone_ok, F.lit(False))).cast("int"),
            "q_bad_miles": _outside("miles", rules.min_miles, rules.max_miles, open_low=True),
            "q_bad_time": _outside("time_s", rules.min_time_s, rules.max_time_s, open_low=False),
            "q_bad_fare": _outside("fare", rules.min_fare, rules.max_fare, open_low=True),
            "q_bad_speed": flag(too_fast),
            "q_bad_pay": flag(unpaid),
        }
    )


def violations() -> Column:
    """Number of broken rules of a flagged row."""
    return reduce(add, [F.col(f) for f in FLAGS])


def breaks_none() -> Column:
    """No rule is broken. One condition per rule, the cheap ones first: each is pushed down as far as
    its columns allow and the first broken one ends the test of a row."""
    cheap_first = [f for f in FLAGS if f != "q_out_of_month"] + ["q_out_of_month"]
    return reduce(and_, [F.col(f) == 0 for f in cheap_first])


def _in_month(ts: str, month: str) -> Column:
    """The time lies in the calendar month that starts on the given date."""
    return F.trunc(F.col(ts).cast("date"), "MM") == F.col(month)


def quality_counts(flagged: DataFrame, *keys: str) -> DataFrame:
    """Rows, violations per rule and rejected rows, in total or per key. One row may break several rules."""
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_raw"),
        *[F.sum(f).alias(f) for f in FLAGS],
        F.sum((violations() > 0).cast("int")).alias("n_rejected"),
        F.sum((violations() == 0).cast("int")).alias("n_silver"),
    )


def derive_columns(flagged: DataFrame, zones: DataFrame, rules: CleaningRules = CLEANING, groups: Groups = GROUPS) -> DataFrame:
    """Keep the rows that break no rule, look up both zone groups and add the derived columns.

    ``zones`` (zone, grp) is joined in two roles; the optimizer broadcasts it when its size allows.
    """
    wait = second_diff("request_ts", "pickup_ts")
    origin = zones.select(F.col("zone").alias("_pz"), F.col("grp").alias("pu_grp"))
    target = zones.select(F.col("zone").alias("_dz"), F.col("grp").alias("do_grp"))
    kept = flagged.where(breaks_none())
    joined = kept.join(origin, kept.pu == F.col("_pz"), "left").join(target, kept.dl == F.col("_dz"), "left")
    total = reduce(add, [F.col(c) for c in ("fare", "tolls", "bcf", "tax", "cong_sur", "airport_fee", "cbd_fee")])
    return joined.withColumns(
        {
            "d": F.col("pickup_ts").cast("date"),
            "hr": F.hour("pickup_ts").cast("tinyint"),
            "dow": iso_dow("pickup_ts").cast("tinyint"),
            "wait_min": F.when(wait.between(0, int(rules.max_wait_min * 60)), wait / 60.0),
            "mph": F.col("miles") / (F.col("time_s") / 3600.0),
            "touch_crz": ((F.col("pu_grp") == groups.treated) | (F.col("do_grp") == groups.treated)).cast("int"),
            "rider_cost": total,
        }
    ).drop("_pz", "_dz", *FLAGS)


def clean_trips(trips: DataFrame, zones: DataFrame, rules: CleaningRules = CLEANING, month: str = "src_month") -> DataFrame:
    """Standardised trips to cleaned trips in one lazy plan."""
    return derive_columns(add_quality_flags(trips, rules, month), zones, rules)


def classify_zones(zones: DataFrame, share: str = "fee_share", rules: ZoneRules = ZONES, groups: Groups = GROUPS) -> DataFrame:
    """Zone group by ordered rules: unknown, airport, share of charged trips, borough."""
    fee = F.coalesce(F.col(share), F.lit(0.0))
    unknown = F.col("zone").isin(*rules.unknown_zones) | F.col("borough").isNull() | F.col("borough").isin(*rules.unknown_boroughs)
    grp = (
        F.when(unknown, F.lit("UNKNOWN"))
        .when(F.col("zone").isin(*rules.airport_zones), F.lit(groups.airport))
        .when(fee >= rules.full_share, F.lit(groups.treated))
        .when(fee >= rules.partial_share, F.lit(groups.partial))
        .when(F.col("borough") == rules.core_borough, F.lit(groups.near))
        .otherwise(F.lit(groups.far))
    )
    return zones.withColumn("grp", grp)


def flow_type(origin: str = "pu_grp", target: str = "do_grp", treated: str = GROUPS.treated) -> Column:
    """inside, outbound, inbound or none, relative to the treated group."""
    a, b = F.col(origin) == treated, F.col(target) == treated
    return F.when(a & b, "inside").when(a, "outbound").when(b, "inbound").otherwise("none")


def distance_band(km: str, grp: str, groups: Groups = GROUPS) -> Column:
    """Band of distance to the treated area; the treated and straddling groups come first."""
    x = F.col(km)
    return (
        F.when(F.col(grp) == groups.treated, groups.treated)
        .when(F.col(grp) == groups.partial, groups.partial)
        .when(x <= 1.0, "0-1 km")
        .when(x <= 2.5, "1-2.5 km")
        .when(x <= 5.0, "2.5-5 km")
        .when(x <= 10.0, "5-10 km")
        .otherwise(">10 km")
    )


def cut(column: str | Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """Bins between ascending edges, closed on the right or on the left; NULL outside."""
    x = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        inside = (x > low) & (x <= high) if right else (x >= low) & (x < high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def hour_bin(hour: str = "hr") -> Column:
    return cut(hour, [-1, 5, 9, 15, 19, 23], ["00-05", "06-09", "10-15", "16-19", "20-23"])


def distance_bin(miles: str = "miles") -> Column:
    return cut(miles, [0, 1, 2, 3, 5, 10, 1000], ["<1", "1-2", "2-3", "3-5", "5-10", ">10"], right=False)


def same_window(d: str = "d", base_year: int = 2024, later_year: int = 2025) -> Column:
    """The days from 5 January on, in both years."""
    x = F.col(d)
    return (x.between(F.lit(f"{base_year}-01-05").cast("date"), F.lit(f"{base_year}-12-31").cast("date"))) | (
        x.between(F.lit(f"{later_year}-01-05").cast("date"), F.lit(f"{later_year}-12-31").cast("date"))
    )


def day_chunk(ts: str, month: str, step: int, n_chunks: int) -> Column:
    """Chunk number of a row inside its file's month; rows outside the month or without time go to the last."""
    inside = _in_month(ts, month)
    by_day = F.floor((F.dayofmonth(F.col(ts).cast("date")) - 1) / step).cast("int")
    return F.when(inside, F.least(by_day, F.lit(n_chunks - 1))).otherwise(F.lit(n_chunks - 1))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULLs with the exact column medians, which scalar subqueries deliver to the scan."""
    medians = {c: exact_quantiles(df, [], c, [0.5]).select("value").scalar() for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), medians[c]) for c in columns})


def dummies(df: DataFrame, column: str, values: list, prefix: str) -> DataFrame:
    """One 0/1 column per listed value."""
    return df.withColumns({f"{prefix}{v}": flag(F.col(column) == v) for v in values})
