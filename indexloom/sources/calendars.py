"""Review schedules and business-day lookups; a calendar is a table with a row a day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Frequency(StrEnum):
    CUSTOM = "custom"
    WEEKLY = "weekly"
    MONTHLY = "monthly"
    QUARTERLY = "quarterly"
    SEMI_ANNUAL = "semi_annual"
    ANNUAL = "annual"


def weekdays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """``(business_date)``: Mondays to Fridays from ``start`` to ``end``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("business_date"))
    return days.where(F.weekday("business_date") < 5)


def to_calendar(spark: SparkSession, dates: DataFrame | Iterable) -> DataFrame:
    """``(business_date)``, each day once, of a table with that column, or of dates, times and ISO texts; anything else is an error."""
    if isinstance(dates, DataFrame):
        return dates.select(F.col("business_date").cast("date").alias("business_date")).where("business_date IS NOT NULL").distinct()
    days = set()
    for d in dates:
        if isinstance(d, str):
            d = dt.datetime.fromisoformat(d)
        if not isinstance(d, dt.date):
            raise TypeError(f"no date: {d!r}")
        days.add(d.date() if isinstance(d, dt.datetime) else d)
    return spark.createDataFrame([(d,) for d in sorted(days)], "business_date date")


def is_anchor(d: Column, frequency: Frequency) -> Column:
    """True on the days that end a period: Fridays, or the last day of a month, quarter, half or year."""
    last = d == F.last_day(d)
    return {
        Frequency.WEEKLY: F.weekday(d) == 4, Frequency.MONTHLY: last, Frequency.QUARTERLY: last & (F.month(d) % 3 == 0),
        Frequency.SEMI_ANNUAL: last & F.month(d).isin(6, 12), Frequency.ANNUAL: last & (F.month(d) == 12),
    }[frequency]


def period(d: Column, frequency: Frequency) -> Column:
    """A number that grows by 1 from each period to the next."""
    months = F.year(d) * 12 + F.month(d) - 1
    if frequency == Frequency.WEEKLY:
        return F.floor(F.date_diff(d, F.lit("1970-01-05").cast("date")) / 7)
    return F.floor(months / {Frequency.MONTHLY: 1, Frequency.QUARTERLY: 3, Frequency.SEMI_ANNUAL: 6, Frequency.ANNUAL: 12}[frequency])


def schedule(days: DataFrame, frequency: Frequency, start: str, end: str, lag: int = 0) -> DataFrame:
    """``(effective_date, reference_date)``: the last business day up to each anchor, and ``lag`` business days before it.

    One pass over the calendar: the last business day so far, and the one
    ``lag`` before that, are carried to the anchors.
    """
    spark = days.sparkSession
    d = days.select(F.col("business_date").cast("date").alias("d")).distinct()
    earlier = F.lag("d", lag).over(Window.orderBy("d")) if lag else F.col("d")
    d = d.withColumn("r", earlier)
    anchors = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    anchors = anchors.where(is_anchor(F.col("d"), frequency)).withColumn("anchor", F.lit(True))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    both = d.withColumn("b", F.struct("d", "r")).join(anchors, "d", "full").withColumn("last", F.last("b", True).over(w)).where("anchor")
    out = both.select(F.col("last.d").alias("effective_date"), F.col("last.r").alias("reference_date")).where("effective_date IS NOT NULL AND reference_date IS NOT NULL").distinct()
    return out.where((F.col("effective_date") >= F.lit(start).cast("date")) & (F.col("effective_date") <= F.lit(end).cast("date")))


def with_neighbours(reviews: DataFrame) -> DataFrame:
    """Previous and next effective and reference dates of each review."""
    w = Window.orderBy("effective_date")
    for c in ("effective_date", "reference_date"):
        reviews = reviews.withColumn(f"previous_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    return reviews


def frequency_diagnostics(reviews: DataFrame, frequency: Frequency) -> DataFrame:
    """Each review with its period, how many reviews the period has, and how many periods were left out before it."""
    p = period(F.col("effective_date"), frequency).cast("long")
    d = reviews.select("effective_date").distinct().withColumn("period", p)
    d = d.withColumn("reviews_in_period", F.count("*").over(Window.partitionBy("period")))
    before = F.lag("period").over(Window.orderBy("effective_date"))
    return d.withColumn("missing_periods", F.coalesce(F.greatest(F.col("period") - before - 1, F.lit(0)), F.lit(0)))


def validate_frequency(reviews: DataFrame, frequency: Frequency, extra_ok: bool = False, gaps_ok: bool = True) -> DataFrame:
    if frequency != Frequency.CUSTOM:
        extra, gaps = frequency_diagnostics(reviews, frequency).agg(F.count_if(F.col("reviews_in_period") > 1), F.count_if(F.col("missing_periods") > 0)).first()
        if (extra and not extra_ok) or (gaps and not gaps_ok):
            raise ValueError(f"{frequency}: {extra} reviews share a period, {gaps} follow a gap")
    return reviews


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both schedules, each review once; one effective date with two reference dates is an error when it is read."""
    u = a.select("effective_date", "reference_date").unionByName(b.select("effective_date", "reference_date")).distinct()
    n = F.count("*").over(Window.partitionBy("effective_date"))
    return u.withColumn("effective_date", F.when(n > 1, F.raise_error(F.lit("one review has two reference dates")).cast("date")).otherwise(F.col("effective_date")))


def month_partitions(start: str, end: str) -> list[tuple[str, str]]:
    """First and last day of each calendar month's part of the range."""
    a, z = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    out = []
    while a <= z:
        nxt = (a.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        out.append((a.isoformat(), min(z, nxt - dt.timedelta(days=1)).isoformat()))
        a = nxt
    return out
