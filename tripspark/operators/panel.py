"""Unit-by-period tables for the causal estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.config import FIRST_WEEK, GROUPS, LAST_DAY, POLICY_DATE, Groups
from tripspark.functions.exprs import flag, ratio, safe_ln, sunday_week, year_month
from tripspark.operators.clean import flow_type, hour_bin
from tripspark.operators.gold import MEASURE_NAMES
from tripspark.operators.timeops import relative_periods

RATIOS = (
    "ln_n fare_pm pay_pm fare_pt pay_pt mph min_pt miles_pt wait rider_pt cbd_pt tips_pt pay_share cbd_share shared_pct"
).split()


def ratio_columns() -> dict[str, Column]:
    """The 15 outcomes, each a ratio of sums; NULL where a denominator is 0."""
    return {
        "ln_n": safe_ln("n"),
        "fare_pm": ratio("fare", "miles"),
        "pay_pm": ratio("pay", "miles"),
        "fare_pt": ratio("fare", "n"),
        "pay_pt": ratio("pay", "n"),
        "mph": ratio("miles", F.col("time_s") / 3600.0),
        "min_pt": ratio("time_s", "n") / 60.0,
        "miles_pt": ratio("miles", "n"),
        "wait": ratio("wait_sum", "wait_n"),
        "rider_pt": ratio("rider_cost", "n"),
        "cbd_pt": ratio("cbd", "n"),
        "tips_pt": ratio("tips", "n"),
        "pay_share": 100.0 * ratio("pay", "fare"),
        "cbd_share": 100.0 * ratio("n_cbd", "n"),
        "shared_pct": 100.0 * ratio("shared_req", "n"),
    }


def add_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(ratio_columns())


def _day(value) -> Column:
    return F.lit(str(value)).cast("date")


def balanced_units(cells: DataFrame, unit: list[str], period: str, min_pre: float, is_pre: Column, pre_divisor: float) -> DataFrame:
    """Units with a row in every period and a large enough volume before the policy, with that volume.

    ``cells`` has one row per unit and period, so a count is a distinct count.
    """
    periods = cells.agg(F.countDistinct(period)).scalar()
    stats = cells.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("_periods"), (F.sum(F.when(is_pre, F.col("n"))) / pre_divisor).alias("w_pre")
    )
    return stats.where((F.col("_periods") == periods) & (F.col("w_pre") >= min_pre)).drop("_periods")


def _treatment(df: DataFrame, post: Column, groups: Groups) -> DataFrame:
    df = df.withColumns({"treat": flag(F.col("grp") == groups.treated), "post": flag(post)})
    return df.withColumn("tp", F.col("treat") * F.col("post"))


def zone_week(
    table: DataFrame,
    zones: DataFrame,
    service: str | None = "hvfhv",
    groups: tuple[str, ...] = GROUPS.panel,
    min_daily: float = 100.0,
    extra: tuple[str, ...] = (),
    start=FIRST_WEEK,
    end=LAST_DAY,
    policy=POLICY_DATE,
    names: Groups = GROUPS,
    balanced: bool = True,
) -> DataFrame:
    """Zone × Sunday-week panel with treatment, relative week, position week and ratios.

    Without ``balanced``, zones with missing weeks stay in, as long as they pass the volume floor.
    """
    rows = table if service is None else table.where(F.col("service") == service)
    rows = rows.where(F.col("d").between(_day(start), _day(end)))
    cells = rows.groupBy("zone", sunday_week("d").alias("wk")).agg(*[F.sum(c).alias(c) for c in [*MEASURE_NAMES, *extra]])
    cells = cells.join(zones.where(F.col("grp").isin(*groups)).select("zone", "grp", "borough"), "zone")
    is_pre = F.col("wk") < _day(policy)
    days = float((policy - start).days)
    if balanced:
        keep = balanced_units(cells, ["zone"], "wk", min_daily, is_pre, days)
    else:
        keep = cells.groupBy("zone").agg((F.sum(F.when(is_pre, F.col("n"))) / days).alias("w_pre")).where(F.col("w_pre") >= min_daily)
    out = _treatment(cells.join(keep, "zone"), F.col("wk") >= _day(policy), names)
    return add_ratios(relative_periods(out, "wk").drop("iso_week").withColumn("month", year_month("wk")))


def zone_day(
    table: DataFrame,
    zones: DataFrame,
    service: str | None = "hvfhv",
    groups: tuple[str, ...] = GROUPS.panel,
    min_daily: float = 100.0,
    pre_days: float = 366.0,
    policy=POLICY_DATE,
    names: Groups = GROUPS,
    first: str = "2024-01-01",
    last: str = "2025-12-31",
) -> DataFrame:
    """Zone × day panel of large zones; missing days stay missing."""
    rows = table if service is None else table.where(F.col("service") == service)
    rows = rows.where(F.col("d").between(_day(first), _day(last))).groupBy("zone", "d").agg(*[F.sum(c).alias(c) for c in MEASURE_NAMES])
    cells = rows.join(zones.where(F.col("grp").isin(*groups)).select("zone", "grp", "borough"), "zone")
    volume = cells.groupBy("zone").agg((F.sum(F.when(F.col("d") < _day(policy), F.col("n"))) / pre_days).alias("w_pre"))
    out = _treatment(cells.join(volume.where(F.col("w_pre") >= min_daily), "zone"), F.col("d") >= _day(policy), names)
    return add_ratios(out.withColumn("weekend", flag(F.weekday("d") >= 5)))


def od_panel(
    table: DataFrame,
    zones: DataFrame,
    service: str | None = "hvfhv",
    min_mean: float = 300.0,
    groups: tuple[str, ...] = GROUPS.panel,
    period: Column | None = None,
    first: str = "2024-01",
    last: str = "2025-12",
    policy: str = "2025-01",
    names: Groups = GROUPS,
) -> DataFrame:
    """Balanced origin–destination pair × period panel. The period is the month unless another key is given."""
    rows = table if service is None else table.where(F.col("service") == service)
    rows = rows.where(F.col("ym").between(first, last))
    key = (F.col("ym") if period is None else period).alias("period")
    cells = rows.groupBy("pu", "dl", key).agg(*[F.sum(c).alias(c) for c in MEASURE_NAMES], F.min("ym").alias("ym"))
    named = zones.where(F.col("grp").isin(*groups))
    cells = cells.join(named.select(F.col("zone").alias("pu"), F.col("grp").alias("pu_grp")), "pu")
    cells = cells.join(named.select(F.col("zone").alias("dl"), F.col("grp").alias("do_grp")), "dl")
    is_pre = F.col("period") < F.lit(policy)
    periods = cells.agg(F.countDistinct("period")).scalar()
    stats = cells.groupBy("pu", "dl").agg(F.count(F.lit(1)).alias("_p"), F.avg(F.when(is_pre, F.col("n"))).alias("w_pre"))
    keep = stats.where((F.col("_p") == periods) & (F.col("w_pre") >= min_mean)).drop("_p")
    out = cells.join(keep, ["pu", "dl"]).withColumns(
        {
            "pair": F.concat_ws("_", "pu", "dl"),
            "ftype": flow_type(treated=names.treated),
            "treat": flag((F.col("pu_grp") == names.treated) | (F.col("do_grp") == names.treated)),
            "post": flag(F.col("period") >= F.lit(policy)),
        }
    )
    return add_ratios(out.withColumn("tp", F.col("treat") * F.col("post")))


def zone_hour_bins(
    table: DataFrame,
    zones: DataFrame,
    service: str | None = "hvfhv",
    groups: tuple[str, ...] = GROUPS.panel,
    min_daily: float = 100.0,
    pre_days: float = 366.0,
    period: Column | None = None,
    first: str = "2024-01",
    last: str = "2025-12",
    policy: str = "2025-01",
    names: Groups = GROUPS,
) -> DataFrame:
    """Zone × hour bin × period table of large zones."""
    rows = table if service is None else table.where(F.col("service") == service)
    rows = rows.where(F.col("ym").between(first, last))
    rows = rows.join(zones.where(F.col("grp").isin(*groups)).select("zone", "grp"), "zone")
    rows = rows.withColumn("period", F.col("ym") if period is None else period)
    volume = rows.groupBy("zone").agg((F.sum(F.when(F.col("period") < policy, F.col("n"))) / pre_days).alias("w_pre"))
    cells = rows.groupBy("zone", "grp", "period", hour_bin("hr").alias("hbin")).agg(*[F.sum(c).alias(c) for c in MEASURE_NAMES])
    out = cells.join(volume.where(F.col("w_pre") >= min_daily), "zone")
    return add_ratios(_treatment(out, F.col("period") >= F.lit(policy), names))


def zone_month_long(
    table: DataFrame,
    zones: DataFrame,
    service: str | None = "hvfhv",
    groups: tuple[str, ...] = GROUPS.panel,
    min_daily: float = 100.0,
    first: str = "2022-01-01",
    last: str = "2025-12-31",
    names: Groups = GROUPS,
) -> DataFrame:
    """Balanced zone × month panel over the long pre-period, for zones large enough in the last pre-year."""
    rows = table if service is None else table.where(F.col("service") == service)
    rows = rows.where(F.col("d").between(_day(first), _day(last)))
    rows = rows.join(zones.where(F.col("grp").isin(*groups)).select("zone", "grp"), "zone")
    in_base = F.col("d").between(_day("2024-01-07"), _day("2025-01-04"))
    volume = rows.groupBy("zone").agg((F.sum(F.when(in_base, F.col("n"))) / 364.0).alias("w_pre"))
    cells = rows.groupBy("zone", "grp", year_month("d").alias("ym")).agg(*[F.sum(c).alias(c) for c in MEASURE_NAMES])
    months = cells.agg(F.countDistinct("ym")).scalar()
    full = cells.groupBy("zone").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") == months).drop("_m")
    out = cells.join(volume.where(F.col("w_pre") >= min_daily), "zone").join(full, "zone", "left_semi")
    out = out.withColumns(
        {
            "treat": flag(F.col("grp") == names.treated),
            "year": F.substring("ym", 1, 4).cast("int"),
            "moy": F.substring("ym", 6, 2).cast("int"),
        }
    )
    out = out.withColumn("post", flag(F.col("year") >= 2025))
    return add_ratios(out).withColumn("rider_ex_pt", ratio(F.col("rider_cost") - F.col("cbd"), "n"))
