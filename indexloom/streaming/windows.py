"""Incremental forms: event-time windows, sessions and a carried index level."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums by type and window; on a stream, rows later than ``late`` are left out and windows end with the watermark."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Spells of a user's events with no pause of ``gap`` or more."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return g.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events", "value")


def levels(returns: DataFrame, base: float = 100.0) -> DataFrame:
    """``(index_id, business_date, level)`` of streamed ``(index_id, business_date, return)``: the level is the state carried on.

    Rows of a batch go by date; a date at or before the last one is a repeat and left out.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (base, "")
        rows = pd.concat(list(batches)).sort_values("business_date")
        out = []
        for date, r in zip(rows["business_date"].astype(str), rows["return"]):
            if date > last:
                level, last = level * (1 + r), date
                out.append((key[0], date, level))
        state.update((level, last))
        yield pd.DataFrame(out, columns=["index_id", "business_date", "level"])

    d = returns.select("index_id", F.col("business_date").cast("string").alias("business_date"), "return")
    return d.groupBy("index_id").applyInPandasWithState(step, "index_id string, business_date string, level double", "level double, last string", "append", GroupStateTimeout.NoTimeout)
