"""From a universe to weights: standardised factors, tilts, quantile selection, and optimised weights review by review.

Cross-sectional steps are windows over a review. Optimisation is a grouped
function: a review's problem is one task, reviews run side by side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, normal_cdf
from . import risk, solvers
from .reviews import REVIEW


class Tilt(StrEnum):
    EXPONENTIAL = "exponential"
    POWER = "power"
    PROPORTIONAL = "proportional"


class Criterion(StrEnum):
    COUNT = "count"
    WEIGHT_COVERAGE = "weight_coverage"


class Weighting(StrEnum):
    PROPORTIONAL = "proportional"
    EQUAL = "equal"


def standardised(df: DataFrame, fields: Sequence[str], by: Sequence[str] = (REVIEW,), clip: float = 3.0, missing: float = 0.0, suffix: str = "_zscore") -> DataFrame:
    """z-scores by review with population deviation, clipped; missing values get ``missing``, a constant field 0 for all."""
    w = Window.partitionBy(*by)
    for f in fields:
        x = F.when(finite(f), F.col(f).cast("double"))
        sd = F.stddev_pop(x).over(w)
        z = F.when(x.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - F.avg(x).over(w)) / sd)))
        df = df.withColumn(f + suffix, F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.coalesce(z, F.lit(missing))))
    return df


def _score(weights: Mapping[str, float], suffix: str) -> Column:
    return sum((F.col(f + suffix) * float(c) for f, c in weights.items()), F.lit(0.0))


def tilted(df: DataFrame, tilts: Mapping[str, float], scheme: Tilt = Tilt.EXPONENTIAL, strength: float = 1.0, clip: float = 20.0, by: Sequence[str] = (REVIEW,), base: str = "benchmark_weight", suffix: str = "_zscore", output: str = "index_weight") -> DataFrame:
    """Benchmark weights times a multiplier of the clipped score, normalised: ``factor_score`` and ``output``."""
    if not tilts or strength <= 0 or clip <= 0:
        raise ValueError("tilts, a positive strength and a positive clip are needed")
    score = F.greatest(F.lit(-clip), F.least(F.lit(clip), _score(tilts, suffix)))
    df = df.withColumn("factor_score", score)
    s = F.col("factor_score")
    multiplier = {Tilt.EXPONENTIAL: F.exp(strength * s), Tilt.POWER: F.pow(normal_cdf(s), F.lit(strength)) if scheme == Tilt.POWER else F.lit(None), Tilt.PROPORTIONAL: F.greatest(1 + strength * s, F.lit(0.0))}[scheme]
    df = df.withColumn("__raw", F.col(base) * multiplier)
    return df.withColumn(output, F.col("__raw") / F.sum("__raw").over(Window.partitionBy(*by))).drop("__raw")


def selected(
    df: DataFrame, signals: Mapping[str, float], fraction: float = 0.4, criterion: Criterion = Criterion.COUNT, within: str | None = None, weighting: Weighting = Weighting.PROPORTIONAL,
    liquidity: str | None = None, least: float | None = None, by: Sequence[str] = (REVIEW,), base: str = "benchmark_weight", suffix: str = "_zscore", output: str = "index_weight",
) -> DataFrame:
    """The best part of each review, or of each class ``within`` it, by score: ``selection_score``, ``selected``, ``output``.

    By count: ``ceil(fraction * n)``, at least 1. By weight: the best names up
    to and with the one that reaches the part. Ties go to the smaller id. A
    class keeps its benchmark weight; null is a class. Names below the least
    liquidity are not eligible.
    """
    if not signals or not 0 < fraction <= 1 or (liquidity is None) != (least is None):
        raise ValueError("signals, a fraction in (0, 1], and liquidity with its least are needed")
    scope = [*by, *([within] if within else [])]
    ok = F.coalesce(F.col(liquidity) >= least, F.lit(False)) if liquidity else F.lit(True)
    df = df.withColumn("__w", F.col(base) / F.sum(base).over(Window.partitionBy(*by))).withColumn("selection_score", _score(signals, suffix)).withColumn("__ok", ok)
    best = Window.partitionBy(*scope, "__ok").orderBy(F.desc("selection_score"), F.col("instrument_id").cast("string"))
    group = Window.partitionBy(*scope, "__ok")
    rank = F.row_number().over(best)
    if criterion == Criterion.COUNT:
        inside = rank <= F.greatest(F.lit(1), F.ceil(fraction * F.count("*").over(group)))
    else:
        before = F.coalesce(F.sum("__w").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        inside = (rank == 1) | (before < fraction * F.sum("__w").over(group))
    df = df.withColumn("selected", F.col("__ok") & inside)
    chosen = F.when(F.col("selected"), F.col("__w") if weighting == Weighting.PROPORTIONAL else F.lit(1.0)).otherwise(0.0)
    scoped = Window.partitionBy(*scope)
    df = df.withColumn("__c", chosen).withColumn("__total", F.sum("__w").over(scoped) if within else F.lit(1.0))
    return df.withColumn(output, F.when(F.col("selected"), F.col("__c") / F.sum("__c").over(scoped) * F.col("__total")).otherwise(0.0)).drop("__w", "__ok", "__c", "__total")


@dataclass(frozen=True)
class Exposure:
    """A bound on ``sum(field * w)``: equal to, at least or at most ``target``, within ``tolerance``."""

    field: str
    target: float
    direction: str = "equal"
    tolerance: float = 0.0

    def row(self, pdf: pd.DataFrame) -> solvers.Linear:
        low = self.target - self.tolerance if self.direction in ("equal", "at_least") else -np.inf
        high = self.target + self.tolerance if self.direction in ("equal", "at_most") else np.inf
        return solvers.Linear(self.field, pdf[self.field].to_numpy(float), low, high)


@dataclass(frozen=True)
class Limits:
    """What weights of a review must meet.

    ``groups``: by class column, how far a class may be from its benchmark
    weight (null is a class); ``relative_groups``: how far as a part of it.
    ``investment``: what weights sum to. ``capacity``: weight up to a multiple of the
    benchmark's. ``liquid``: column of tradable value, with portfolio value
    and participation, that bounds a weight.
    """

    minimum: float = 0.0
    maximum: float = 1.0
    capacity: float | None = None
    groups: Mapping[str, float] = field(default_factory=dict)
    relative_groups: Mapping[str, float] = field(default_factory=dict)
    investment: float = 1.0
    exposures: tuple[Exposure, ...] = ()
    liquid: str | None = None
    portfolio_value: float = 1.0
    participation: float = 1.0

    def bounds(self, pdf: pd.DataFrame, benchmark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upper = np.full(len(pdf), self.maximum)
        if self.capacity is not None:
            upper = np.minimum(upper, self.capacity * benchmark)
        if self.liquid:
            upper = np.minimum(upper, pdf[self.liquid].to_numpy(float) * self.participation / self.portfolio_value)
        lower = np.minimum(np.full(len(pdf), self.minimum), upper)
        return lower, upper

    def rows(self, pdf: pd.DataFrame, benchmark: np.ndarray) -> list[solvers.Linear]:
        out = [e.row(pdf) for e in self.exposures]
        for column, tolerance, part in [*((c, t, False) for c, t in self.groups.items()), *((c, t, True) for c, t in self.relative_groups.items())]:
            for value in pdf[column].unique():
                inside = (pdf[column].isna() if pd.isna(value) else pdf[column] == value).to_numpy(float)
                held = float(inside @ benchmark) * self.investment
                room = tolerance * held if part else tolerance
                out.append(solvers.Linear(f"{column}={value}", inside, held - room, held + room))
        return out


def _per_review(df: DataFrame, solve, by: str = REVIEW, output: str = "index_weight") -> DataFrame:
    """``df`` with weights that ``solve(pdf)`` gives each review, and its ``solver_status``; an infeasible review has none."""
    df = df.drop(output, "solver_status")
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", {output} double, solver_status string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("instrument_id", ignore_index=True)
        try:
            w, status = solve(pdf).weights, "solved"
        except solvers.Infeasible as e:
            w, status = np.full(len(pdf), np.nan), f"infeasible: {e}"
        return pdf.assign(**{output: w, "solver_status": status})

    return df.groupBy(by).applyInPandas(run, schema)


def _benchmark(pdf: pd.DataFrame) -> np.ndarray:
    b = pdf["benchmark_weight"].to_numpy(float)
    if not np.isfinite(b).all() or (b < 0).any() or b.sum() <= 0:
        raise solvers.Infeasible("benchmark weights must be finite, non-negative and not all zero")
    return b / b.sum()


def projected(df: DataFrame, limits: Limits, desired: str = "index_weight", by: str = REVIEW) -> DataFrame:
    """The weights nearest the ``desired`` ones that meet the limits."""
    df = df.withColumn("__desired", F.col(desired))

    def solve(pdf: pd.DataFrame) -> solvers.Solution:
        b = _benchmark(pdf)
        return solvers.closest(pdf["__desired"].to_numpy(float), *limits.bounds(pdf, b), limits.rows(pdf, b), limits.investment)

    return _per_review(df, solve, by).drop("__desired")


def minimum_variance(df: DataFrame, cov: DataFrame, limits: Limits, by: str = REVIEW, tracking_error: float | None = None, turnover: float | None = None, reference: str | None = None, ridge: float = 1e-8) -> DataFrame:
    """Least-variance weights of each review with the covariances ``(<by>, i, j, cov)`` of its instruments.

    Each instrument's row carries its row of the matrix, so one group has all.
    """
    rows = cov.groupBy(by, F.col("i").alias("instrument_id")).agg(F.map_from_entries(F.collect_list(F.struct("j", "cov"))).alias("__cov"))
    joined = df.join(rows, [by, "instrument_id"])
    names = [c for c in df.columns if c not in ("index_weight", "solver_status")]

    def solve(pdf: pd.DataFrame) -> solvers.Solution:
        ids = pdf["instrument_id"].tolist()
        m = np.array([[dict(r).get(j, np.nan) for j in ids] for r in pdf["__cov"]], float)
        if not np.isfinite(m).all():
            raise solvers.Infeasible("covariances are missing")
        m = (m + m.T) / 2 + ridge * np.eye(len(m))
        m -= min(np.linalg.eigvalsh(m).min(), 0) * np.eye(len(m))
        b = _benchmark(pdf)
        ref = pdf[reference].to_numpy(float) if reference else b
        return solvers.minimum_variance(m, *limits.bounds(pdf, b), limits.rows(pdf, b), limits.investment, b, tracking_error, ref, turnover)

    return _per_review(joined.select(*names, "__cov"), solve, by).drop("__cov")


def least_variance(df: DataFrame, panel: DataFrame, column: str, limits: Limits, by: str = REVIEW, least: int = 2, ridge: float = 1e-8) -> DataFrame:
    """``minimum_variance`` with the ``risk.covariance`` of each review's ``panel``, whose table is never made.

    Each instrument's row carries its returns, so a review's task grows with
    names times dates. Names without returns, and reviews of which two names
    share fewer than ``least`` dates, have no weights.
    """
    d = risk.observed(panel, column, [by]).groupBy(by, "instrument_id", F.unix_date(F.to_date("business_date")).alias("t")).agg(F.last("r").alias("r"))
    d = d.groupBy(by, "instrument_id").agg(F.collect_list(F.struct("t", "r")).alias("x"))
    d = d.select(by, "instrument_id", F.col("x.t").alias("__t"), F.col("x.r").alias("__r"))
    names = [c for c in df.columns if c not in ("index_weight", "solver_status")]

    def solve(pdf: pd.DataFrame) -> solvers.Solution:
        at = np.repeat(np.arange(len(pdf)), pdf["__t"].map(len))
        dates, when = np.unique(np.concatenate(pdf["__t"].tolist()), return_inverse=True)
        x = np.full((len(pdf), len(dates)), np.nan)
        x[at, when] = np.concatenate(pdf["__r"].tolist())
        b = _benchmark(pdf)
        return solvers.least_variance(solvers.pairwise(x, least).positive(ridge), *limits.bounds(pdf, b), limits.rows(pdf, b), limits.investment)

    return _per_review(df.select(*names).join(d, [by, "instrument_id"]), solve, by).drop("__t", "__r")


def entropy_targets(df: DataFrame, targets: Sequence[Exposure], limits: Limits | None = None, mode: str = "hard", penalty: float = 100.0, by: str = REVIEW) -> DataFrame:
    """Weights of least relative entropy to the benchmark that meet exposure targets.

    ``hard``: exactly, within tolerances; ``elastic``: missing costs; ``hard_then_elastic``: the second where the first has none. Names without benchmark weight stay at 0.
    """
    lim = limits or Limits()

    def solve(pdf: pd.DataFrame) -> solvers.Solution:
        b = _benchmark(pdf)
        lower, upper = lim.bounds(pdf, b)
        lower, upper = np.where(b > 0, lower, 0.0), np.where(b > 0, upper, 0.0)
        e = pdf[[t.field for t in targets]].to_numpy(float)
        want = np.array([t.target for t in targets])
        plain = not lim.groups and not lim.exposures and (lower <= 0).all() and (upper[b > 0] >= 1).all()

        def hard() -> solvers.Solution:
            if plain and all(t.direction == "equal" and t.tolerance == 0 for t in targets):
                return solvers.kl_dual(e, b, want)
            return solvers.kl_project(b, lower, upper, [*lim.rows(pdf, b), *(t.row(pdf) for t in targets)])

        def elastic() -> solvers.Solution:
            return solvers.kl_dual(e, b, want, penalty) if plain else solvers.kl_elastic(e, b, want, lower, upper, lim.rows(pdf, b), penalty)

        if mode == "elastic":
            return elastic()
        try:
            return hard()
        except solvers.Infeasible:
            if mode == "hard":
                raise
            return elastic()

    return _per_review(df, solve, by)


def relative_entropy(df: DataFrame, by: Sequence[str] = (REVIEW,), weight: str = "index_weight", prior: str = "benchmark_weight") -> DataFrame:
    """Sum of ``w * ln(w / b)``; infinite where weight stands on no prior."""
    w, b = F.col(weight), F.col(prior)
    term = F.when(w > 0, F.when(b > 0, w * F.ln(w / b)).otherwise(F.lit(float("inf")))).otherwise(0.0)
    return df.groupBy(*by).agg(F.sum(term).alias("relative_entropy"))


def constraint_report(df: DataFrame, coefficients: DataFrame, bounds: DataFrame, by: Sequence[str] = (REVIEW,), tolerance: float = 1e-7) -> DataFrame:
    """Value, slacks, violation and status of each constraint.

    ``coefficients (constraint_name, instrument_id, coefficient)``, ``bounds (constraint_name, lower, upper)`` with nulls for none.
    """
    v = df.join(coefficients, "instrument_id").groupBy(*by, "constraint_name").agg(F.sum(F.col("index_weight") * F.col("coefficient")).alias("value"))
    d = v.join(bounds, "constraint_name").withColumn("lower_slack", F.col("value") - F.col("lower")).withColumn("upper_slack", F.col("upper") - F.col("value"))
    d = d.withColumn("violation", F.greatest(-F.col("lower_slack"), -F.col("upper_slack"), F.lit(0.0)))
    close = F.coalesce(F.least("lower_slack", "upper_slack") <= tolerance, F.lit(False))
    status = F.when(~finite("value"), "invalid").when(F.col("violation") > tolerance, "violated").when(close, "binding").otherwise("satisfied")
    return d.withColumn("status", status)




def bounds(df: DataFrame, limits: Limits) -> DataFrame:
    """``df`` with the ``lower`` and ``upper`` bound that ``limits`` give each weight."""
    upper = [F.lit(float(limits.maximum))]
    if limits.capacity is not None:
        upper.append(limits.capacity * F.col("benchmark_weight"))
    if limits.liquid:
        upper.append(F.col(limits.liquid) * limits.participation / limits.portfolio_value)
    high = F.least(*upper) if len(upper) > 1 else upper[0]
    return df.withColumns({"lower": F.least(F.lit(float(limits.minimum)), high), "upper": high})
