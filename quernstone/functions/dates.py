"""Weeks, seasons and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isoweek_to_date(value: Column) -> Column:
    """The Monday of an ISO week written YYYY-Www, YYYYWww, YYYYww or YYYY-ww; dates stay; else null."""
    text = F.trim(value)
    pattern = r"^(\d{4})-?[Ww]?(\d{2})$"
    year, week = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
    monday = F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (week - 1) * 7)
    valid = week.between(1, 53) & (F.weekofyear(monday) == week)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date")).when(valid, monday)


def week_end(day: Column) -> Column:
    """The Sunday that ends a day's week."""
    return F.date_add(F.date_trunc("week", day).cast("date"), 6)


def harmonics(day: Column, period: float = 52.18) -> tuple[Column, Column]:
    angle = 2 * F.pi() * F.weekofyear(day) / period
    return F.sin(angle), F.cos(angle)


def digest_due(frequency: Column, last_sent: Column, now: Column) -> Column:
    """Immediate: always; daily: after one day; weekly and unknown: after seven; never sent: due."""
    days = (F.unix_timestamp(now) - F.unix_timestamp(last_sent)) / 86400
    return F.when(last_sent.isNull() | (frequency == "immediate"), True).when(frequency == "daily", days >= 1).otherwise(days >= 7)


def day_offsets(df: DataFrame, day: str, by: list[str] | None = None, name: str = "offset") -> DataFrame:
    """``df`` with the days since the first day of its group (of the table without groups); numbers count as days already."""
    kind = dict(df.dtypes)[day]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return df.withColumn(name, F.col(day).cast("double"))
    days = F.to_date(F.col(day))
    first = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by or []]).agg(F.min(days).alias("_first"))  # an aggregation, no window over the table
    joined = df.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else df.crossJoin(F.broadcast(first))  # one row
    return joined.withColumn(name, F.datediff(days, F.col("_first")).cast("double")).select(*df.columns, name)


def horizon(days: Column) -> Column:
    return F.greatest(F.lit(1), F.least(days, F.lit(3650)))


#: Days between rows, up to which a series counts as of a frequency, and its seasonal period.
FREQUENCIES = [(0.9, "H", 24), (3.0, "D", 7), (10.0, "W", 52), (45.0, "M", 12), (120.0, "Q", 4), (float("inf"), "Y", 0)]


def frequency(median_gap_days: float | None) -> tuple[str, int]:
    """Frequency and seasonal period of a series by the median gap between its rows."""
    return next(((f, p) for most, f, p in FREQUENCIES if median_gap_days is not None and median_gap_days <= most), ("D", 7))
