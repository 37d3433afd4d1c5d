"""Baseline against candidates: each table has a ``candidate`` column, so any number compare in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TOLERANCE, change_status
from .reviews import REVIEW, exposures, metrics


class Incompatible(ValueError):
    """Runs differ in what no comparison can bridge."""


def stacked(candidates: Mapping[str, DataFrame]) -> DataFrame:
    """Tables of candidates on top of each other, each row with its candidate's name."""
    out = None
    for name, df in candidates.items():
        d = df.withColumn("candidate", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one candidate is needed")
    return out


def coverage(baseline: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which of them has each review: ``(candidate, effective_date, in_baseline, in_candidate)``."""
    names = F.broadcast(candidates.select("candidate").distinct())
    b = baseline.select(REVIEW).distinct().join(names).withColumn("in_baseline", F.lit(True))
    c = candidates.select("candidate", REVIEW).distinct().withColumn("in_candidate", F.lit(True))
    return b.join(c, ["candidate", REVIEW], "full").fillna(False, ["in_baseline", "in_candidate"])


def weights(baseline: DataFrame, candidates: DataFrame, tolerance: float = TOLERANCE, column: str = "index_weight") -> DataFrame:
    """Both weights of each instrument of either, on reviews that both have: difference and status."""
    dates = coverage(baseline, candidates).where("in_baseline AND in_candidate").select("candidate", REVIEW)
    b = baseline.select(REVIEW, "instrument_id", F.col(column).alias("baseline_weight")).join(F.broadcast(dates), REVIEW)
    c = candidates.select("candidate", REVIEW, "instrument_id", F.col(column).alias("candidate_weight")).join(F.broadcast(dates), ["candidate", REVIEW])
    d = b.join(c, ["candidate", REVIEW, "instrument_id"], "full").fillna(0.0, ["baseline_weight", "candidate_weight"])
    d = d.withColumn("weight_difference", F.col("candidate_weight") - F.col("baseline_weight")).withColumn("absolute_weight_difference", F.abs("weight_difference"))
    return d.withColumn("status", change_status("baseline_weight", "candidate_weight", tolerance, False))


def overview(compared: DataFrame) -> DataFrame:
    """By candidate and review: one-way difference, largest difference, entrants and exits."""
    return compared.groupBy("candidate", REVIEW).agg(
        (0.5 * F.sum("absolute_weight_difference")).alias("one_way_weight_difference"), F.max("absolute_weight_difference").alias("maximum_weight_difference"),
        F.count_if(F.col("status") == "entrant").alias("entrants"), F.count_if(F.col("status") == "exit").alias("exits"), F.count_if(F.col("status") != "unchanged").alias("changed"),
    )


def metric_differences(baseline: DataFrame, candidates: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long differences of value columns on keys that both have: ``(candidate, <keys>, metric, baseline_value, candidate_value, difference)``."""
    pairs = lambda d, side, more=(): d.select(*more, *keys, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("p")).select(*more, *keys, "p.metric", F.col("p.value").alias(f"{side}_value"))
    d = pairs(baseline, "baseline").join(pairs(candidates, "candidate", ("candidate",)), [*keys, "metric"])
    return d.select("candidate", *keys, "metric", "baseline_value", "candidate_value", (F.col("candidate_value") - F.col("baseline_value")).alias("difference"))


def exposure_differences(baseline: DataFrame, candidates: DataFrame, classification: str) -> DataFrame:
    """Class weights of both by review; a class that one lacks weighs 0 there."""
    b = exposures(baseline, classification).select(REVIEW, classification, F.col("portfolio_weight").alias("baseline_value"))
    names = F.broadcast(candidates.select("candidate").distinct())
    c = candidates.groupBy("candidate", REVIEW, F.coalesce(F.when(F.trim(classification) != "", F.col(classification)), F.lit("Unclassified")).alias(classification)).agg(F.sum("index_weight").alias("candidate_value"))
    d = b.join(names).join(c, ["candidate", REVIEW, classification], "full").fillna(0.0, ["baseline_value", "candidate_value"])
    return d.withColumn("difference", F.col("candidate_value") - F.col("baseline_value"))


def review_metric_differences(baseline: DataFrame, candidates: Mapping[str, DataFrame]) -> DataFrame:
    values = ["constituent_count", "max_weight", "top_10_weight", "hhi", "effective_n", "active_share"]
    return metric_differences(metrics(baseline), stacked({k: metrics(d) for k, d in candidates.items()}), [REVIEW], values)


def compatibility(baseline: Mapping[str, str], candidates: Mapping[str, Mapping[str, str]], fatal: Sequence[str] = ("currency", "calendar_id"), require_equal: bool = False) -> list[dict]:
    """Differences of run metadata; those in ``fatal`` (or any, if equality is required) raise."""
    rows = []
    for name, c in candidates.items():
        for k in sorted(set(baseline) | set(c)):
            same = baseline.get(k) == c.get(k)
            rows.append({"candidate": name, "field": k, "baseline_value": baseline.get(k), "candidate_value": c.get(k), "is_equal": same})
            if not same and (require_equal or k in fatal):
                raise Incompatible(f"{name}: {k} differs: {baseline.get(k)!r} and {c.get(k)!r}")
    return rows


def parameter_differences(baseline: Mapping, candidates: Mapping[str, Mapping]) -> list[dict]:
    """Leaves of nested parameters that differ, by dotted path."""

    def leaves(v, at: str = "") -> dict:
        if isinstance(v, Mapping):
            return {k: x for key, item in v.items() for k, x in leaves(item, f"{at}.{key}" if at else str(key)).items()}
        return {at: v}

    base, out = leaves(baseline), []
    for name, c in candidates.items():
        other = leaves(c)
        out += [{"candidate": name, "parameter": k, "baseline_value": base.get(k), "candidate_value": other.get(k)} for k in sorted(set(base) | set(other)) if base.get(k) != other.get(k)]
    return out
