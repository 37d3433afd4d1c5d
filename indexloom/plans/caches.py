"""Caches of source data in a store: whole calendar months are kept, and only missing ones are asked for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.calendars import month_partitions
from .recipes import digest
from .store import Mode, Store, covering

Load = Callable[[str, str], DataFrame]


def canonical(df: DataFrame, start: str, end: str, date: str = "business_date", key: str = "instrument_id") -> DataFrame:
    """Rows of the range, dates as dates and ids as text; null keys and dates, and repeated pairs of them, are an error when read."""
    d = df.withColumns({date: F.col(date).cast("date"), key: F.col(key).cast("string")} if key in df.columns else {date: F.col(date).cast("date")})
    bad = F.raise_error(F.lit(f"null {date} or {key}")).cast("boolean")
    null = F.col(date).isNull() | (F.col(key).isNull() if key in df.columns else F.lit(False))
    return d.where(F.when(null, bad).otherwise(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))))


class SourceCache:
    """Daily tables by month: a range is read from stored months, which cover it, and from the provider where none does.

    A range that was stored as such is taken as it is; else whole months are
    loaded, stored and cut. All consecutive missing months are one request.
    ``requests`` counts what the provider was asked.
    """

    def __init__(self, store: Store, stage: str, identity: Mapping[str, Any], load: Load, date: str = "business_date", key: str = "instrument_id", mode: Mode = Mode.REUSE) -> None:
        self.store, self.stage, self.identity, self._load, self.date, self.key, self.mode = store, stage, dict(identity), load, date, key, mode
        self.requests: list[tuple[str, str]] = []

    def _key(self) -> str:
        return digest(self.identity)

    def _stored(self) -> dict[str, str]:
        """Path by the range it holds."""
        if self.mode in (Mode.OFF, Mode.REFRESH):
            return {}
        held = self.store.catalog().where((F.col("stage") == self.stage) & (F.col("cache_key") == self._key()) & (F.col("status") != "invalidated"))
        return {r["name"]: r["path"] for r in held.select("name", "path").collect()}  # a row a month

    def _ask(self, start: str, end: str) -> DataFrame:
        self.requests.append((start, end))
        return canonical(self._load(start, end), start, end, self.date, self.key)

    def load(self, start: str, end: str) -> DataFrame:
        """Rows from ``start`` to ``end``, both included."""
        if self.mode == Mode.OFF:
            return self._ask(start, end)
        stored = self._stored()
        full = [(a[:8] + "01", _month_end(a)) for a, _ in month_partitions(start, end)]
        missing = [m for m in full if f"{m[0]}..{m[1]}" not in stored]
        if missing and covering([tuple(n.split("..")) for n in stored], start, end) is not None:
            missing = []
        if missing and self.mode == Mode.READ_ONLY:
            raise LookupError(f"{self.stage}: {missing[0][0]} to {missing[-1][1]} is not stored")
        for first, last in _runs(missing):  # one request and one table for consecutive months, each of which is bound to it
            got = self._ask(first, last)
            reference = self.store.save(got, [c for c in dict.fromkeys((self.date, self.key)) if c in got.columns])
            months = [f"{a}..{z}" for a, z in missing if first <= a <= last]
            self.store.bind_all([(self.stage, self._key(), m) for m in months], reference)
            stored |= dict.fromkeys(months, reference.path)
        parts = covering([tuple(n.split("..")) for n in stored], start, end) or []
        day, at = F.col(self.date), start
        spans: list[list[str]] = []  # path, first and last day: each day from one table only
        for a, z in parts:
            last = min(z, end)
            if spans and spans[-1][0] == stored[f"{a}..{z}"]:
                spans[-1][2] = last
            else:
                spans.append([stored[f"{a}..{z}"], at, last])
            at = _next_day(z)
        out = None
        for path, first, last in spans:
            d = self.store.spark.read.parquet(path).where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
            out = d if out is None else out.unionByName(d)
        return out


class BusinessDayCache(SourceCache):
    """Business days of a calendar, by month."""

    def __init__(self, store: Store, calendar_id: str, load: Load, mode: Mode = Mode.REUSE) -> None:
        super().__init__(store, "business_days", {"calendar_id": calendar_id}, load, "business_date", "business_date", mode)


def _month_end(day: str) -> str:
    return month_partitions(day[:8] + "01", day[:8] + "28")[0][1][:8] + str(_days(day))


def _days(day: str) -> int:
    import calendar

    return calendar.monthrange(int(day[:4]), int(day[5:7]))[1]


def _next_day(day: str) -> str:
    import datetime as dt

    return (dt.date.fromisoformat(day) + dt.timedelta(days=1)).isoformat()


def _runs(months: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Consecutive months put together."""
    out: list[tuple[str, str]] = []
    for a, z in months:
        if out and _next_day(out[-1][1]) == a:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out
