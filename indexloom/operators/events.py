"""Event windows over return series, by position in the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import compound

EXACT, NEXT, PREVIOUS = "exact", "next", "previous"


def positions(dates: DataFrame, date: str = "business_date") -> DataFrame:
    """``dates`` with ``position`` from 0; a calendar has a row a day."""
    return dates.withColumn("position", F.row_number().over(Window.orderBy(date)) - 1)


def aligned_events(events: DataFrame, calendar: DataFrame, alignment: str = NEXT) -> DataFrame:
    """``(requested_event_date, position)``: the date itself, or the next or previous one there is; null if none.

    An as-of join by sorting both into one sequence: linear, whatever the
    calendar's length.
    """
    e = events.select(F.col("event_date").cast("date").alias("d")).where("d IS NOT NULL").distinct().select("d", F.lit(None).cast("int").alias("position"), F.lit(1).alias("is_event"))
    both = e.unionByName(calendar.select(F.col("business_date").alias("d"), "position", F.lit(0).alias("is_event")))
    if alignment == EXACT:
        found = F.max("position").over(Window.partitionBy("d"))
    elif alignment == NEXT:
        found = F.min("position").over(Window.orderBy(F.col("d").desc(), "is_event").rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.max("position").over(Window.orderBy("d", "is_event").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("found", found).where("is_event = 1").select(F.col("d").alias("requested_event_date"), F.col("found").alias("position"))


def windows(series: DataFrame, events: DataFrame, index: str, benchmark: str | None = None, before: int = 5, after: int = 5, alignment: str = NEXT, complete: bool = True) -> DataFrame:
    """Returns around each event, abnormal and cumulated; windows that leave the calendar are skipped, or cut if not ``complete``."""
    b = F.col(benchmark) if benchmark else F.lit(0.0)
    d = positions(series.where(F.col(index).isNotNull() & b.isNotNull()).select("business_date", F.col(index).alias("index_return"), b.alias("benchmark_return")))
    e = aligned_events(events, d, alignment).where("position IS NOT NULL").withColumnRenamed("position", "__at")
    size = F.broadcast(d.agg(F.count("*").alias("__n")))
    if complete:
        e = e.join(size).where((F.col("__at") >= before) & (F.col("__at") + after < F.col("__n"))).drop("__n")
    spread = e.select("requested_event_date", "__at", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("relative_day")).withColumn("position", F.col("__at") + F.col("relative_day"))
    w = spread.join(d, "position")
    at = d.select(F.col("position").alias("__at"), F.col("business_date").alias("event_date"))
    w = w.join(at, "__at").withColumn("abnormal_return", F.col("index_return") - F.col("benchmark_return"))
    upto = Window.partitionBy("requested_event_date").orderBy("relative_day").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("cumulative_abnormal_return", F.sum("abnormal_return").over(upto))
    return w.select("requested_event_date", "event_date", "business_date", "relative_day", "index_return", "benchmark_return", "abnormal_return", "cumulative_abnormal_return")


def study(event_windows: DataFrame) -> DataFrame:
    """By relative day: count, mean, median, deviation, standard error and t of abnormal returns, and the mean cumulated one."""
    a = F.col("abnormal_return")
    g = event_windows.groupBy("relative_day").agg(F.count(a).alias("event_count"), F.avg(a).alias("mean_abnormal_return"), F.median(a).alias("median_abnormal_return"), F.stddev_samp(a).alias("standard_deviation"), F.avg("cumulative_abnormal_return").alias("mean_cumulative_abnormal_return"))
    g = g.withColumn("standard_error", F.col("standard_deviation") / F.sqrt("event_count"))
    return g.withColumn("t_statistic", F.when(F.col("standard_error") != 0, F.col("mean_abnormal_return") / F.col("standard_error")))


def event_and_other_returns(series: DataFrame, events: DataFrame, column: str, exclusion: int = 0) -> DataFrame:
    """Compound return of dates within ``exclusion`` of an event (moved to the next date there is), and of all others."""
    d = positions(series.where(F.col(column).isNotNull()).select("business_date", F.col(column).alias("r")))
    e = aligned_events(events, d, NEXT).where("position IS NOT NULL")
    marked = e.select(F.explode(F.sequence(F.col("position") - exclusion, F.col("position") + exclusion)).alias("position")).distinct().withColumn("__e", F.lit(True))
    m = d.join(marked, "position", "left").withColumn("__e", F.coalesce("__e", F.lit(False)))
    hit = F.col("__e")
    return m.agg(
        F.count_if(hit).alias("event_observations"), F.count_if(~hit).alias("non_event_observations"),
        compound(F.when(hit, F.col("r")).otherwise(0.0)).alias("event_compound_return"), compound(F.when(~hit, F.col("r")).otherwise(0.0)).alias("non_event_compound_return"),
    )
