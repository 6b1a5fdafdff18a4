"""Calendar and window operators on daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.config import FIRST_WEEK, POLICY_DATE
from tripspark.functions.exprs import col, flag, iso_dow, ratio, safe_ln


def moving_average(df: DataFrame, value: str, by: list[str], order: str, before: int = 3, after: int = 3, name: str = "ma") -> DataFrame:
    """Centred moving average, NULL where the frame is not full."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after)
    full = F.count(value).over(frame) == before + after + 1
    return df.withColumn(name, F.when(full, F.avg(value).over(frame)))


def lag_rows(df: DataFrame, value: str, by: list[str], order: str, k: int, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value, k).over(Window.partitionBy(*by).orderBy(order)))


def _median_of(values: Column) -> Column:
    """Median of a small array; NULL for an empty one."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2.0)


def robust_anomaly(daily: DataFrame, by: list[str], day: str = "d", value: str = "n", span: int = 28, limit: float = 3.5) -> DataFrame:
    """Robust z-score of the log value against the same weekday within ``span`` days, own day excluded.

    The window holds at most 2 * span / 7 other days, so the collected array is small whatever the
    length of the series.
    """
    df = daily.withColumn("_s", safe_ln(value)).withColumn("_day", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    frame = Window.partitionBy(*by, F.weekday(day)).orderBy("_day").rangeBetween(-span, span)
    df = df.withColumn("_w", F.collect_list(F.struct("_day", "_s")).over(frame))
    others = F.transform(F.filter(F.col("_w"), lambda r: r["_day"] != F.col("_day")), lambda r: r["_s"])
    df = df.withColumn("_o", others).withColumn("expected_log", _median_of(F.col("_o")))
    deviations = F.transform(F.col("_o"), lambda x: F.abs(x - F.col("expected_log")))
    df = df.withColumn("mad", 1.4826 * _median_of(deviations))
    df = df.withColumn("z", F.try_divide(F.col("_s") - F.col("expected_log"), F.nullif(F.col("mad"), F.lit(0.0))))
    df = df.withColumn("dev_pct", 100.0 * (F.exp(F.col("_s") - F.col("expected_log")) - 1.0))
    return df.withColumn("flag", flag(F.abs(F.col("z")) > limit)).drop("_s", "_day", "_w", "_o")


def anomaly_summary(scores: DataFrame, by: list[str], limit: float = 3.5) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("flag").alias("flagged"),
        F.sum(flag(F.col("z") < -limit)).alias("flagged_low"),
        F.sum(flag(F.col("z") > limit)).alias("flagged_high"),
    )


def index_to_base(df: DataFrame, value: str, by: list[str], is_base: Column, name: str = "idx") -> DataFrame:
    """The series as percent of its own mean over the base rows. One small aggregate, joined back."""
    base = df.where(is_base).groupBy(*by).agg(F.avg(value).alias("_base"))
    return df.join(base, by, "left").withColumn(name, 100.0 * ratio(value, "_base")).drop("_base")


def relative_periods(df: DataFrame, day: str) -> DataFrame:
    """Week and month distance to the policy date, position week (mod 52), ISO week and month of year."""
    d = F.col(day).cast("date")
    policy, first = F.lit(str(POLICY_DATE)).cast("date"), F.lit(str(FIRST_WEEK)).cast("date")
    months = (F.year(d) - POLICY_DATE.year) * 12 + F.month(d) - POLICY_DATE.month
    return df.withColumns(
        {
            "k": F.floor(F.datediff(d, policy) / 7).cast("int"),
            "km": months.cast("int"),
            "woy": F.pmod(F.floor(F.datediff(d, first) / 7), F.lit(52)).cast("int"),
            "iso_week": F.weekofyear(d),
            "moy": F.month(d),
        }
    )


def nth_weekday(year: Column, month: int, iso: int, n: int) -> Column:
    """The n-th given weekday (1 = Monday) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, (iso - iso_dow(first) + 7) % 7 + 7 * (n - 1))


def last_monday_of_may(year: Column) -> Column:
    last = F.make_date(year, F.lit(5), F.lit(31))
    return F.date_sub(last, F.weekday(last))


def observed(day: Column) -> Column:
    """A fixed holiday on Saturday moves to Friday, on Sunday to Monday."""
    shift = F.when(iso_dow(day) == 6, -1).when(iso_dow(day) == 7, 1).otherwise(0)
    return F.date_add(day, shift)


def federal_holidays(years: DataFrame) -> DataFrame:
    """Observed US federal holidays of the given years (column ``year``), one row per date."""
    y = F.col("year")
    fixed = [(1, 1), (6, 19), (7, 4), (11, 11), (12, 25)]
    days = [observed(F.make_date(y, F.lit(m), F.lit(d))) for m, d in fixed]
    days += [nth_weekday(y, 1, 1, 3), nth_weekday(y, 2, 1, 3), last_monday_of_may(y)]
    days += [nth_weekday(y, 9, 1, 1), nth_weekday(y, 10, 1, 2), nth_weekday(y, 11, 4, 4)]
    return years.select(F.explode(F.array(*days)).alias("holiday")).distinct()


def calendar_features(days: DataFrame, day: str = "d", start: str | Column = "2022-01-01") -> DataFrame:
    """Weekday dummies, holidays and their neighbours, Christmas window, trend and yearly waves."""
    d = F.col(day)
    years = days.select(F.explode(F.array(F.year(d) - 1, F.year(d), F.year(d) + 1)).alias("year")).distinct()
    hol = federal_holidays(years)
    marks = (
        hol.select(F.col("holiday").alias(day), F.lit(1).alias("_h"), F.lit(0).alias("_a"))
        .unionByName(hol.select(F.date_add("holiday", 1).alias(day), F.lit(0).alias("_h"), F.lit(1).alias("_a")))
        .unionByName(hol.select(F.date_sub("holiday", 1).alias(day), F.lit(0).alias("_h"), F.lit(1).alias("_a")))
        .groupBy(day)
        .agg(F.max("_h").alias("holiday"), F.max("_a").alias("hol_adj"))
    )
    out = days.join(marks, day, "left").fillna(0, ["holiday", "hol_adj"])
    md = F.month(d) * 100 + F.dayofmonth(d)
    angle = 2.0 * 3.141592653589793 * F.dayofyear(d) / 365.25
    origin = F.lit(start).cast("date") if isinstance(start, str) else start
    return out.withColumns(
        {
            **{f"dow{k}": flag(F.weekday(d) == k) for k in range(6)},
            "xmas": flag((md >= 1220) | (md <= 103)),
            "trend": F.datediff(d, origin) / 365.0,
            "sin1": F.sin(angle),
            "cos1": F.cos(angle),
        }
    )


def year_over_year(df: DataFrame, keys: list[str], value: str | Column, year: str = "yr", base: int = 2024, later: int = 2025) -> DataFrame:
    """Values of two years side by side and the percent change."""
    x = col(value)
    wide = df.groupBy(*keys).agg(
        F.sum(F.when(F.col(year) == base, x)).alias(f"y{base}"), F.sum(F.when(F.col(year) == later, x)).alias(f"y{later}")
    )
    return wide.withColumn("yoy_pct", 100.0 * (ratio(f"y{later}", f"y{base}") - 1.0))
