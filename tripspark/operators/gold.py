"""Additive aggregates: counts and sums that can be merged by summing again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.config import GROUPS
from tripspark.functions.exprs import flag, year_month

# Two company codes that get their own counters.
COMPANY_COUNTERS = {"n_uber": "HV0003", "n_lyft": "HV0005"}


def measures() -> dict[str, Column]:
    """Measure name -> how it is computed from cleaned trips. Merging partial tables sums the same names."""
    return {
        "n": F.count(F.lit(1)),
        "fare": F.sum("fare"),
        "pay": F.sum("driver_pay"),
        "miles": F.sum("miles"),
        "time_s": F.sum("time_s"),
        "tips": F.sum("tips"),
        "cbd": F.sum("cbd_fee"),
        "rider_cost": F.sum("rider_cost"),
        "cong_sur": F.sum("cong_sur"),
        "tolls": F.sum("tolls"),
        "wait_sum": F.sum("wait_min"),
        "wait_n": F.count("wait_min"),
        "shared_req": F.sum("shared_req"),
        "n_cbd": F.sum(flag(F.col("cbd_fee") > 0)),
    }


MEASURE_NAMES = "n fare pay miles time_s tips cbd rider_cost cong_sur tolls wait_sum wait_n shared_req n_cbd".split()

# Table -> (grouping keys, extra counters)
TABLES: dict[str, tuple[list[str], list[str]]] = {
    "zone_day_pu": (["service", "d", "zone"], ["n_to_crz", "n_uber", "n_lyft"]),
    "zone_day_do": (["service", "d", "zone"], ["n_from_crz"]),
    "grp_hour_day": (["service", "d", "hr", "pu_grp", "do_grp"], []),
    "company_grp_day": (["service", "company_code", "d", "pu_grp", "do_grp"], []),
    "zone_hour_month": (["service", "ym", "zone", "hr"], []),
    "od_month": (["service", "ym", "pu", "dl"], []),
}


def _extras(treated: str) -> dict[str, Column]:
    out = {
        "n_to_crz": F.sum(flag(F.col("do_grp") == treated)),
        "n_from_crz": F.sum(flag(F.col("pu_grp") == treated)),
    }
    for name, code in COMPANY_COUNTERS.items():
        out[name] = F.sum(flag(F.col("company_code") == code))
    return out


def all_measures(table: str, treated: str = GROUPS.treated) -> dict[str, Column]:
    """Measures and extra counters of a table."""
    return {**measures(), **{name: _extras(treated)[name] for name in TABLES[table][1]}}


def build_gold(trips: DataFrame, table: str, treated: str = GROUPS.treated) -> DataFrame:
    """One aggregate table from cleaned trips: partial aggregation in each task, one shuffle on the keys."""
    keys, _ = TABLES[table]
    zone = "dl" if table == "zone_day_do" else "pu"
    derived = {"zone": F.col(zone), "ym": year_month("d")}
    grouping = [derived[k].alias(k) if k in derived else F.col(k) for k in keys]
    return trips.groupBy(*grouping).agg(*[expr.alias(name) for name, expr in all_measures(table, treated).items()])


def consolidate(partials: DataFrame, table: str) -> DataFrame:
    """Merge partial tables (days, files, chunks) by summing again; all sums become double."""
    keys, extra = TABLES[table]
    return partials.groupBy(*keys).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in MEASURE_NAMES + extra])


def sum_measures(gold: DataFrame, keys: list[str | Column], columns: list[str] | None = None) -> DataFrame:
    """Coarser aggregate of a gold table."""
    return gold.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (columns or MEASURE_NAMES)])
