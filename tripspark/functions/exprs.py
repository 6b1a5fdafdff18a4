"""Column expressions that the operators share. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL where the denominator is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def flag(cond: Column) -> Column:
    """A condition as 0/1; NULL counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def _second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def second_diff(start: str | Column, end: str | Column) -> Column:
    """Whole seconds between two timestamps, counted by second boundaries and free of time zones."""
    a, b = col(start), col(end)
    days = F.datediff(b.cast("date"), a.cast("date")).cast("long")
    return days * 86400 + _second_of_day(b) - _second_of_day(a)


def iso_dow(d: str | Column) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(col(d).cast("date")) + 1


def sunday_week(d: str | Column) -> Column:
    """The Sunday on or before the day."""
    day = col(d).cast("date")
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_ending(d: str | Column, last_dow: int = 7) -> Column:
    """The last day of the week that contains the day (7: weeks end on Sunday, 6: on Saturday)."""
    day = col(d).cast("date")
    return F.date_add(day, (last_dow - iso_dow(day) + 7) % 7)


def year_month(d: str | Column) -> Column:
    """Calendar month as yyyy-MM text."""
    return F.substring(col(d).cast("date").cast("string"), 1, 7)


def uniform01(*parts: str | Column) -> Column:
    """A reproducible uniform number in (0, 1) from the text of the given columns.

    The first 32 bits of an md5 digest: the same value in every engine, on every partitioning
    and after a lost task, which a seeded generator cannot promise.
    """
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4294967296.0)


def laplace_noise(u: Column, scale: Column | float) -> Column:
    """Laplace(0, scale) by inverse distribution function of a uniform number."""
    centred = u - 0.5
    return -F.lit(1.0) * scale * F.signum(centred) * F.ln(1.0 - 2.0 * F.abs(centred))


# Webb's six-point distribution, mean 0 and variance 1.
WEBB_SQUARES = (-1.5, -1.0, -0.5, 0.5, 1.0, 1.5)


def webb_weight(u: Column) -> Column:
    """One of six equally likely bootstrap weights ±sqrt(1.5), ±1, ±sqrt(0.5)."""
    values = [F.signum(F.lit(s)) * F.sqrt(F.abs(F.lit(s))) for s in WEBB_SQUARES]
    return F.get(F.array(*values), F.floor(u * 6).cast("int"))


def safe_ln(c: str | Column) -> Column:
    """Natural logarithm, NULL for values that have none."""
    x = col(c).cast("double")
    return F.when(x > 0, F.ln(x))
