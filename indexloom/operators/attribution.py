"""Brinson-Fachler, Carino-linked and factor attribution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TOLERANCE, classified

COMPONENTS = ("allocation", "selection", "interaction")


def brinson(df: DataFrame, period: str = "period", group: str = "industry", portfolio: str = "index_weight", benchmark: str = "benchmark_weight", ret: str = "asset_return") -> DataFrame:
    """By period and class: weights, returns (0 for no weight), contributions and the three effects; null classes are one."""
    p, b, r = F.col(portfolio), F.col(benchmark), F.col(ret)
    g = df.groupBy(period, classified(group, blank_too=False).alias(group)).agg(F.sum(p).alias("portfolio_weight"), F.sum(b).alias("benchmark_weight"), F.sum(p * r).alias("portfolio_contribution"), F.sum(b * r).alias("benchmark_contribution"))
    for side in ("portfolio", "benchmark"):
        g = g.withColumn(f"{side}_return", F.when(F.col(f"{side}_weight") > 0, F.col(f"{side}_contribution") / F.col(f"{side}_weight")).otherwise(0.0))
    total = g.groupBy(period).agg(F.sum("benchmark_contribution").alias("__b"))
    g = g.join(F.broadcast(total), period)  # a row a period
    active = F.col("portfolio_weight") - F.col("benchmark_weight")
    over = F.col("portfolio_return") - F.col("benchmark_return")
    g = g.withColumn("allocation", active * (F.col("benchmark_return") - F.col("__b"))).withColumn("selection", F.col("benchmark_weight") * over).withColumn("interaction", active * over).drop("__b")
    return g.withColumn("total_attribution", F.col("allocation") + F.col("selection") + F.col("interaction")).withColumn("active_contribution", F.col("portfolio_contribution") - F.col("benchmark_contribution"))


def brinson_totals(detail: DataFrame, period: str = "period") -> DataFrame:
    names = {"portfolio_contribution": "portfolio_return", "benchmark_contribution": "benchmark_return"}
    cols = ["portfolio_contribution", "benchmark_contribution", *COMPONENTS, "total_attribution", "active_contribution"]
    t = detail.groupBy(period).agg(*[F.sum(c).alias(names.get(c, c)) for c in cols])
    return t.withColumn("active_return", F.col("portfolio_return") - F.col("benchmark_return"))


def require_reconciled(totals: DataFrame, tolerance: float = TOLERANCE) -> None:
    off = totals.where(F.abs(F.col("total_attribution") - F.col("active_return")) > max(tolerance, 1e-12)).count()
    if off:
        raise ValueError(f"attribution does not reconcile in {off} periods")


def _carino(p: Column, b: Column, tolerance: float) -> Column:
    d = p - b
    return F.when(F.abs(d) <= tolerance, 1 / (1 + p)).otherwise((F.log1p(p) - F.log1p(b)) / d)


def carino(totals: DataFrame, period: str = "period", tolerance: float = 1e-12) -> DataFrame:
    """Each period's effects scaled so that they add up to the compound active return: one row a period and component."""
    p, b = F.col("portfolio_return"), F.col("benchmark_return")
    whole = totals.agg((F.product(1 + p) - 1).alias("__p"), (F.product(1 + b) - 1).alias("__b"))
    d = totals.join(F.broadcast(whole)).withColumn("linking_coefficient", _carino(p, b, tolerance) / _carino(F.col("__p"), F.col("__b"), tolerance))
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("period_contribution")) for c in COMPONENTS])
    d = d.select(period, "linking_coefficient", F.explode(parts).alias("c")).select(period, "c.*", "linking_coefficient")
    return d.withColumn("linked_contribution", F.col("period_contribution") * F.col("linking_coefficient"))


def carino_totals(linked: DataFrame, totals: DataFrame) -> DataFrame:
    """Linked sums by component, their sum, and the compound active return they meet."""
    by = linked.groupBy("component").agg(F.sum("linked_contribution").alias("linked_contribution"))
    all_ = linked.agg(F.sum("linked_contribution").alias("linked_contribution")).select(F.lit("total_attribution").alias("component"), "linked_contribution")
    active = totals.agg((F.product(1 + F.col("portfolio_return")) - F.product(1 + F.col("benchmark_return"))).alias("linked_contribution")).select(F.lit("multi_period_active_return").alias("component"), "linked_contribution")
    return by.unionByName(all_).unionByName(active)


def factor_model(df: DataFrame, dependent: Column | str, factors: Sequence[str], intercept: bool = True, ridge: float = 0.0) -> tuple[dict[str, float], DataFrame]:
    """Least squares of a return on factor returns: coefficients, and daily contributions with residual.

    Sums of products are one aggregate row over rows that are complete; the
    driver solves a system as large as the factors are many. Without ridge a
    singular system takes the solution of least norm.
    """
    y = F.col(dependent) if isinstance(dependent, str) else dependent
    complete = df.where(y.isNotNull())
    for f in factors:
        complete = complete.where(F.col(f).isNotNull())
    names = ["intercept"] * intercept + list(factors)
    cols = [F.lit(1.0)] * intercept + [F.col(f) for f in factors]
    k = len(cols)
    cells = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]] + [F.sum(a * y) for a in cols] + [F.count("*")]
    row = complete.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
    if row[-1] < k + 1:
        raise ValueError(f"factor attribution requires at least {k + 1} aligned observations")
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = row[: k * (k + 1) // 2]
    xx = xx + np.triu(xx, 1).T
    xy = np.array(row[k * (k + 1) // 2 : -1])
    if ridge > 0:
        penalty = ridge * np.eye(k)
        if intercept:
            penalty[0, 0] = 0.0
        beta = np.linalg.solve(xx + penalty, xy)
    else:
        beta = np.linalg.lstsq(xx, xy, rcond=1e-13)[0]
    found = dict(zip(names, map(float, beta)))
    daily = complete.select("business_date", y.alias("attributed_return"), *[(c * found[n]).alias(f"{n}_contribution") for n, c in zip(names, cols)])
    fitted = sum((F.col(f"{n}_contribution") for n in names), F.lit(0.0))
    return found, daily.withColumn("residual", F.col("attributed_return") - fitted)


def factor_summary(daily: DataFrame) -> DataFrame:
    """Observations, R-squared (null without variance), sums of contributions and residual."""
    y, e = F.col("attributed_return"), F.col("residual")
    sums = [F.sum(c).alias(f"total_{c}") for c in daily.columns if c.endswith("_contribution")]
    d = daily.agg(F.count("*").alias("observations"), F.sum(e * e).alias("residual_sum_squares"), (F.var_pop(y) * F.count("*")).alias("__t"), F.sum(y).alias("total_attributed_return"), F.sum(e).alias("total_residual"), *sums)
    return d.withColumn("r_squared", F.when(F.col("__t") > 0, 1 - F.col("residual_sum_squares") / F.col("__t"))).drop("__t")
