"""Checks of input tables: each is one aggregate job, whatever the number of its rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite

UNIVERSE = ("instrument_id", "name", "country", "industry", "currency", "base_currency", "shares", "price", "market_cap", "benchmark_weight", "free_float", "fx_rate", "reference_date", "effective_date")
MARKET = ("instrument_id", "business_date", "price_return", "gross_dividend", "net_dividend", "market_cap")
SCHEDULE = ("reference_date", "effective_date")


class ContractError(ValueError):
    """A table breaks its contract; the message lists how."""


def require_columns(df: DataFrame, required: Sequence[str], contract: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"{contract} is missing columns: {missing}")


def _long(one: DataFrame) -> DataFrame:
    """``(problem, count)`` of one row of counts, its columns' names the problems."""
    cells = F.array(*[F.struct(F.lit(c).alias("problem"), F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias("count")) for c in one.columns])
    return one.select(F.explode(cells).alias("p")).select("p.*")


def _raise(contract: str, errors: DataFrame) -> None:
    wrong = {r["problem"]: r["count"] for r in errors.where("count > 0").collect()}  # a row a rule
    if wrong:
        raise ContractError(f"{contract}: {wrong}")


def universe_errors(df: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """``(problem, count)`` of each rule of the universe contract, over all reviews; one aggregate."""
    numbers = ("shares", "price", "market_cap", "benchmark_weight", "free_float", "fx_rate")
    bad = [F.count_if(~finite(c) | (F.col(c) < 0)).alias(f"{c} not finite or negative") for c in numbers]
    g = df.groupBy("effective_date").agg(
        F.count_if(F.col("instrument_id").isNull()).alias("null ids"), (F.count("instrument_id") - F.count_distinct("instrument_id")).alias("repeated ids"), *bad,
        F.count_if(F.col("free_float") > 1).alias("free_float above 1"), F.count_if(F.col("fx_rate") <= 0).alias("fx_rate not positive"),
        (F.abs(F.sum("benchmark_weight") - 1) > tolerance).cast("int").alias("benchmark does not sum to 1"),
        (F.count_distinct("reference_date") != 1).cast("int").alias("not one date pair"), F.count_if(F.col("reference_date") > F.col("effective_date")).alias("reference after effective"),
        F.count_if(F.col("effective_date").isNull() | F.col("reference_date").isNull()).alias("null dates"),
    )
    total = g.agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("empty"), *[F.sum(f"`{c}`").alias(c) for c in g.columns if c != "effective_date"])
    return _long(total)


def validate_universe(df: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Ids unique by review and not null, numbers finite and not negative, float in [0, 1], fx positive, benchmark sums to 1, one date pair a review, reference not after effective."""
    require_columns(df, UNIVERSE, "universe")
    _raise("universe", universe_errors(df, tolerance))
    return df


def market_data_errors(df: DataFrame, cutoff=None) -> DataFrame:
    late = F.count_if(F.col("business_date") > F.lit(cutoff)) if cutoff is not None else F.lit(0)
    g = df.groupBy("instrument_id", "business_date").agg(F.count("*").alias("n"), late.alias("late"))
    null = F.col("instrument_id").isNull() | F.col("business_date").isNull()
    return _long(g.agg(F.count_if(null).alias("null keys"), F.count_if(F.col("n") > 1).alias("repeated keys"), F.sum("late").alias("after the cutoff")))


def validate_market_data(df: DataFrame, cutoff=None) -> DataFrame:
    """Keys not null and unique, nothing after ``cutoff``."""
    require_columns(df, MARKET[:3], "daily market data")
    _raise("daily market data", market_data_errors(df, cutoff))
    return df


def schedule_errors(df: DataFrame) -> DataFrame:
    null = F.col("effective_date").isNull() | F.col("reference_date").isNull()
    return _long(df.agg(F.count_if(null).alias("null dates"), (F.count("effective_date") - F.count_distinct("effective_date")).alias("repeated"), F.count_if(F.col("reference_date") > F.col("effective_date")).alias("reference after effective")))


def validate_schedule(df: DataFrame) -> DataFrame:
    """A row an effective date, reference not after it; sorted."""
    require_columns(df, SCHEDULE, "review schedule")
    _raise("review schedule", schedule_errors(df))
    return df.orderBy("effective_date")


def weight_errors(df: DataFrame, column: str = "index_weight", by: Sequence[str] = ("effective_date",), tolerance: float = 1e-8) -> DataFrame:
    g = df.groupBy(*by).agg(F.count_if(~finite(column) | (F.col(column) < 0)).alias("bad"), F.sum(column).alias("total"))
    return _long(g.agg(F.sum("bad").alias("not finite or negative"), F.count_if(F.abs(F.col("total") - 1) > tolerance).alias("groups that do not sum to 1")))


def validate_weights(df: DataFrame, column: str = "index_weight", by: Sequence[str] = ("effective_date",), tolerance: float = 1e-8) -> DataFrame:
    """Finite, not negative, and 1 in sum by group."""
    _raise("weights", weight_errors(df, column, by, tolerance))
    return df


def date_coverage(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """``(business_date, problem)``: dates of the calendar that are missing, and unexpected ones."""
    have, want = df.select("business_date").distinct(), calendar.select("business_date").distinct()
    missing = want.join(have, "business_date", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.join(want, "business_date", "left_anti").withColumn("problem", F.lit("unexpected")))
