"""Returns, levels, drawdowns and rolling risk of return series.

A series is ``(<keys>, business_date, return)``: any number of series pass in
one plan, each a partition of its keys, so cost grows with rows and a series
is as long as its calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import YEAR_DAYS, annualised_return, annualised_volatility, business_days, compound, finite, ratio

#: Largest fall that still counts as none, for episodes.
NOISE = 1e-15


def _order(by: Sequence[str], date: str = "business_date") -> Window:
    return Window.partitionBy(*by).orderBy(date)


def require_returns(df: DataFrame, column: str, keys: Sequence[str]) -> None:
    """One job: returns are finite, none below -100 %, keys unique; else ValueError."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~finite(column)).alias("odd"), F.count_if(F.col(column) < -1).alias("low"))
    n, twice, odd, low = bad.agg(F.count("*"), F.count_if(F.col("n") > 1), F.sum("odd"), F.sum("low")).first()
    if not n or twice or odd or low:
        raise ValueError(f"{column}: {n} keys, {twice} repeated, {odd} not finite, {low} below -1")


def level(column: str, by: Sequence[str]) -> Column:
    return F.product(1 + F.col(column)).over(_order(by).rowsBetween(Window.unboundedPreceding, 0))


def with_drawdown(df: DataFrame, column: str = "return", by: Sequence[str] = (), prefix: str = "", base: float | None = None) -> DataFrame:
    """``df`` with level and drawdown; the peak is over levels only, or over ``base`` too."""
    upto = _order(by).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(f"{prefix}level", level(column, by))
    peak = F.max(f"{prefix}level").over(upto)
    return df.withColumn(f"{prefix}drawdown", F.col(f"{prefix}level") / (peak if base is None else F.greatest(F.lit(base), peak)) - 1)


def summary(df: DataFrame, column: str = "return", by: Sequence[str] = (), year: int = YEAR_DAYS, base: float | None = None) -> DataFrame:
    """A row a series: observations, total and annualised return, volatility, maximum drawdown."""
    d = with_drawdown(df, column, by, "__", base)
    d = d.groupBy(*by).agg(F.count(column).alias("observations"), compound(column).alias("total_return"), annualised_volatility(column, year).alias("annualized_volatility"), F.min("__drawdown").alias("maximum_drawdown"))
    return d.withColumn("annualized_return", annualised_return("total_return", "observations", year))


def against_benchmark(df: DataFrame, index: str, benchmark: str, by: Sequence[str] = (), year: int = YEAR_DAYS, base: float | None = None) -> DataFrame:
    """``summary`` of both over dates that have both, tracking error, annualised excess and information ratio (null without error)."""
    both = df.where(F.col(index).isNotNull() & F.col(benchmark).isNotNull())
    d = with_drawdown(with_drawdown(both, index, by, "__i_", base), benchmark, by, "__b_", base)
    d = d.groupBy(*by).agg(
        F.count(index).alias("observations"), compound(index).alias("total_return"), annualised_volatility(index, year).alias("annualized_volatility"), F.min("__i_drawdown").alias("maximum_drawdown"),
        compound(benchmark).alias("benchmark_total_return"), annualised_volatility(benchmark, year).alias("benchmark_annualized_volatility"), F.min("__b_drawdown").alias("benchmark_maximum_drawdown"),
        annualised_volatility(F.col(index) - F.col(benchmark), year).alias("tracking_error"),
    )
    d = d.withColumn("annualized_return", annualised_return("total_return", "observations", year)).withColumn("benchmark_annualized_return", annualised_return("benchmark_total_return", "observations", year))
    d = d.withColumn("annualized_excess_return", F.col("annualized_return") - F.col("benchmark_annualized_return"))
    return d.withColumn("information_ratio", ratio("annualized_excess_return", "tracking_error"))


#: Pairs of return columns, the most inclusive first: the first whose index column is there is used, alone.
RETURN_PAIRS = (("index_net_total_return", "benchmark_net_total_return"), ("index_gross_total_return", "benchmark_gross_total_return"), ("index_price_return", "benchmark_price_return"), ("index_return", "benchmark_return"))


def core_performance(df: DataFrame, by: Sequence[str] = (), year: int = YEAR_DAYS) -> DataFrame:
    """``against_benchmark`` of the first return pair there is, with drawdowns from a base of 1."""
    for index, benchmark in RETURN_PAIRS:
        if index in df.columns:
            if benchmark in df.columns:
                return against_benchmark(df, index, benchmark, by, year, 1.0)
            return summary(df, index, by, year, 1.0)
    raise ValueError("no return column")


def rolling_risk(df: DataFrame, index: str, benchmark: str, by: Sequence[str] = (), windows: Sequence[int] = (21, 63, 252), year: int = YEAR_DAYS, least: float | None = None) -> DataFrame:
    """``(<by>, business_date, window, annualized_volatility, tracking_error, correlation)`` over trailing rows.

    A window counts when full, or from ``max(2, ceil(least * window))`` rows on.
    """
    both = df.where(F.col(index).isNotNull() & F.col(benchmark).isNotNull())
    structs = []
    for n in windows:
        need = n if least is None else max(2, math.ceil(least * n))
        w = _order(by).rowsBetween(-(n - 1), 0)
        active = F.col(index) - F.col(benchmark)
        values = {"annualized_volatility": F.stddev_samp(index).over(w) * math.sqrt(year), "tracking_error": F.stddev_samp(active).over(w) * math.sqrt(year), "correlation": F.corr(index, benchmark).over(w)}
        full = F.count("*").over(w) >= need
        structs.append(F.struct(F.lit(n).alias("window"), *[F.when(full, v).alias(k) for k, v in values.items()]))
    out = both.select(*by, "business_date", F.array(*structs).alias("r"))  # windows first, then their rows
    out = out.select(*by, "business_date", F.explode("r").alias("r")).select(*by, "business_date", "r.*")
    return out.where("annualized_volatility IS NOT NULL")


def calendar_years(df: DataFrame, index: str, benchmark: str, by: Sequence[str] = ()) -> DataFrame:
    """Compound, active, best and worst returns of each year, over dates that have both."""
    both = df.where(F.col(index).isNotNull() & F.col(benchmark).isNotNull())
    g = both.groupBy(*by, F.year("business_date").cast("string").alias("period"))
    out = g.agg(F.count("*").alias("observations"), F.min("business_date").alias("start_date"), F.max("business_date").alias("end_date"), compound(index).alias("index_return"), compound(benchmark).alias("benchmark_return"))
    return out.withColumn("active_return", F.col("index_return") - F.col("benchmark_return"))


def drawdown_episodes(df: DataFrame, column: str = "return", by: Sequence[str] = ()) -> DataFrame:
    """Each fall below the peak: start, trough, end, depth, weekdays, and whether it recovered.

    It ends on the first date back at the peak, or on the last date there is.
    """
    d = with_drawdown(df, column, by, "__")
    below = F.col("__drawdown") < -NOISE
    w = _order(by)
    starts = below & ~F.coalesce(F.lag(below).over(w), F.lit(False))
    d = d.withColumn("__below", below).withColumn("__episode", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__next", F.lead("business_date").over(w))
    e = d.where("__below").groupBy(*by, F.col("__episode").alias("episode")).agg(
        F.min("business_date").alias("start_date"), F.min(F.struct("__drawdown", "business_date")).alias("t"), F.max(F.struct("business_date", "__next")).alias("l"),
    )
    end = F.coalesce("l.__next", "l.business_date")
    return e.select(*by, "episode", "start_date", F.col("t.business_date").alias("trough_date"), end.alias("end_date"), F.col("t.__drawdown").alias("maximum_drawdown"), F.col("l.__next").isNotNull().alias("recovered"), business_days("start_date", end).cast("long").alias("duration_business_days"))
