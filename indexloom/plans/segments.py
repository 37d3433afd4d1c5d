"""Simulation by stored segments: what is known of a holding segment is read, only the rest is computed.

Between two reviews the factors of each date depend on the segment's targets
and observations alone (see ``operators.simulation``), so a segment is named
by a digest of these and its configuration, whatever run computes it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import simulation
from .store import Store, missing_segments, segment_key

STAGE = "segment"


@dataclass(frozen=True)
class Report:
    """How many segments a run read, and how many it computed."""

    reused: int
    computed: int


def keyed(h: DataFrame, configuration: Mapping[str, Any]) -> DataFrame:
    """``(segment, segment_key)``: one row a segment; keys cover targets, dates and observations, by sums of row hashes."""
    big = "decimal(38,0)"
    rows = F.xxhash64("portfolio", "instrument_id", "business_date", "weight", "price_return", "gross_dividend", "net_dividend", "mass")
    sums = h.groupBy("segment").agg(F.sum(rows.cast(big)).alias("content"), F.count("*").alias("rows"), F.max("business_date").alias("last"))
    spark = h.sparkSession
    found = [(r["segment"], segment_key({**configuration, "rows": r["rows"], "last": str(r["last"])}, int(r["content"]), None)) for r in sums.collect()]  # a row a review
    return spark.createDataFrame(found, "segment date, segment_key string")


def daily(store: Store, h: DataFrame, configuration: Mapping[str, Any], dividends: simulation.Dividends = simulation.Dividends.STANDARD) -> tuple[DataFrame, Report]:
    """``simulation.daily`` of held rows ``h``, segments that the store has taken from there, the others computed and stored."""
    keys = keyed(h, {**configuration, "dividends": str(dividends)})
    held = store.catalog().where((F.col("stage") == STAGE) & (F.col("status") != "invalidated"))
    new = missing_segments(keys, held.select(F.col("cache_key").alias("segment_key")))
    fresh = {r["segment"]: r["segment_key"] for r in new.collect()}  # a row a review
    if fresh:
        some = h.where(F.col("segment").isin(list(fresh)))
        by_date = some.select("business_date", "segment").distinct()
        made = simulation.factors(some, dividends).join(by_date, "business_date")
        made = made.withColumn("segment_key", F.element_at(F.create_map(*[x for s, k in fresh.items() for x in (F.lit(s), F.lit(k))]), F.col("segment")))
        reference = store.save(made.drop("segment"), ["segment_key", "business_date"])  # one table for all new segments
        store.bind_all([(STAGE, k, "factors") for k in fresh.values()], reference)
    wanted = keys.select("segment_key", F.lit(True).alias("wanted"))
    paths = store.catalog().where((F.col("stage") == STAGE) & (F.col("status") != "invalidated")).join(wanted, F.col("cache_key") == F.col("segment_key")).select("path").distinct().collect()
    f = store.spark.read.parquet(*[r["path"] for r in paths]).join(F.broadcast(wanted), "segment_key").drop("wanted", "segment_key")
    return simulation.levelled(f), Report(keys.count() - len(fresh), len(fresh))
