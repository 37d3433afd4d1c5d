"""Review statistics, exposures and constituent changes over stacked review tables.

A review table is ``(effective_date, instrument_id, index_weight,
benchmark_weight, ...)``, all reviews in one DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TOLERANCE, change_status, classified, finite, ratio

REVIEW = "effective_date"


def validation(reviews: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Counts, sums and extremes of the weights of each review."""
    w, b = F.col("index_weight"), F.col("benchmark_weight")
    return reviews.groupBy(REVIEW).agg(
        F.count("*").alias("instrument_count"), F.count_if(w > tolerance).alias("portfolio_constituent_count"), F.count_if(b > tolerance).alias("benchmark_constituent_count"),
        F.sum(w).alias("portfolio_weight_sum"), F.sum(b).alias("benchmark_weight_sum"), F.min(w).alias("minimum_portfolio_weight"), F.max(w).alias("maximum_portfolio_weight"),
    )


def concentration(weights: DataFrame, by: Sequence[str] = (REVIEW,), column: str = "index_weight", tops: Sequence[int] = (1, 5, 10), tolerance: float = TOLERANCE) -> DataFrame:
    """Count, largest, HHI, effective count and the sums of the largest few of each group; only the few are ranked beyond a task."""
    w = F.col(column)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(w.desc(), "instrument_id"))
    few = weights.select(*by, "instrument_id", column).withColumn("__rank", rank).where(F.col("__rank") <= max(tops))
    top = few.groupBy(*by).agg(*[F.sum(F.when(F.col("__rank") <= k, w)).alias(f"top_{k}_weight") for k in tops])
    all_ = weights.groupBy(*by).agg(F.count_if(w > tolerance).alias("constituent_count"), F.max(w).alias("maximum_weight"), F.sum(w * w).alias("hhi"))
    joined = all_.join(top, list(by)) if by else all_.crossJoin(top)  # one row each
    return joined.withColumn("effective_constituent_count", ratio(F.lit(1.0), "hhi"))


def metrics(reviews: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Constituent count, largest and ten largest weights, HHI, effective N and active share of each review."""
    share = reviews.groupBy(REVIEW).agg((0.5 * F.sum(F.abs(F.col("index_weight") - F.col("benchmark_weight")))).alias("active_share"))
    c = concentration(reviews, tops=(10,), tolerance=tolerance)
    return c.join(share, REVIEW).select(REVIEW, "constituent_count", F.col("maximum_weight").alias("max_weight"), "top_10_weight", "hhi", F.col("effective_constituent_count").alias("effective_n"), "active_share")


def exposures(reviews: DataFrame, classification: str) -> DataFrame:
    """Weights by class and review; null and blank classes are ``Unclassified``, as is everything without the column."""
    c = classified(classification) if classification in reviews.columns else classified(F.lit(None).cast("string"))
    g = reviews.groupBy(REVIEW, c.alias(classification)).agg(F.sum("index_weight").alias("portfolio_weight"), F.sum("benchmark_weight").alias("benchmark_weight"))
    return g.withColumn("active_weight", F.col("portfolio_weight") - F.col("benchmark_weight"))


def _long(df: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("double").alias("value")) for f in fields])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.field_name", "__p.value")


def weighted_exposures(df: DataFrame, fields: Sequence[str], by: Sequence[str] = (), portfolio: str = "index_weight", benchmark: str = "benchmark_weight") -> DataFrame:
    """Sums of field times weight by group and field, as they are, not by coverage."""
    long = _long(df, [*by, portfolio, benchmark], fields)
    g = long.groupBy(*by, "field_name").agg(F.sum(F.col(portfolio) * F.col("value")).alias("portfolio_exposure"), F.sum(F.col(benchmark) * F.col("value")).alias("benchmark_exposure"))
    return g.withColumn("active_exposure", F.col("portfolio_exposure") - F.col("benchmark_exposure"))


def field_statistics(df: DataFrame, fields: Sequence[str], by: Sequence[str] = (REVIEW,), tolerance: float = TOLERANCE) -> DataFrame:
    """Exposures over the weight that has the field, with coverage; null where that is no more than the tolerance."""
    long = _long(df, [*by, "index_weight", "benchmark_weight"], fields).withColumn("__ok", finite("value"))
    ok, v = F.col("__ok"), F.col("value")
    agg: list[Column] = [F.count("*").alias("instrument_count"), F.count_if(ok).alias("available_count"), F.count_if(~ok).alias("missing_count")]
    for side in ("index", "benchmark"):
        w = F.col(f"{side}_weight")
        agg += [F.sum(F.when(ok, w).otherwise(0.0)).alias(f"{side}_weight_coverage"), F.sum(F.when(ok, w * v)).alias(f"__{side}")]
    g = long.groupBy(*by, "field_name").agg(*agg)
    for side in ("index", "benchmark"):
        g = g.withColumn(f"{side}_exposure", F.when(F.col(f"{side}_weight_coverage") > tolerance, F.col(f"__{side}") / F.col(f"{side}_weight_coverage"))).drop(f"__{side}")
    return g.withColumn("active_exposure", F.col("index_exposure") - F.col("benchmark_exposure"))


def capacity(reviews: DataFrame, limit: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Weight against capacity limit of each constituent that has one, with use (null for a limit of zero) and breach."""
    rows = reviews.where(finite(limit)).select(REVIEW, "instrument_id", "index_weight", F.col(limit).alias("capacity_limit"))
    return rows.withColumn("capacity_utilisation", ratio("index_weight", "capacity_limit")).withColumn("capacity_breach", F.col("index_weight") > F.col("capacity_limit") + tolerance)


def adjacent(reviews: DataFrame) -> DataFrame:
    """``(effective_date, previous_effective_date)`` of each review after the first; a row a review."""
    dates = reviews.select(REVIEW).distinct()
    return dates.withColumn("previous_effective_date", F.lag(REVIEW).over(Window.orderBy(REVIEW))).where("previous_effective_date IS NOT NULL")


def changes(reviews: DataFrame, tolerance: float = TOLERANCE, by_difference: bool = False, column: str = "index_weight") -> DataFrame:
    """Each instrument of either of two adjacent reviews: both weights (0 if absent), change and status."""
    pairs = F.broadcast(adjacent(reviews))
    now = reviews.select(REVIEW, "instrument_id", F.col(column).alias("current_weight")).join(pairs, REVIEW)
    before = reviews.select(F.col(REVIEW).alias("previous_effective_date"), "instrument_id", F.col(column).alias("previous_weight")).join(pairs, "previous_effective_date")
    keys = [REVIEW, "previous_effective_date", "instrument_id"]
    both = now.join(before, keys, "full").select(*keys, F.coalesce("previous_weight", F.lit(0.0)).alias("previous_weight"), F.coalesce("current_weight", F.lit(0.0)).alias("current_weight"))
    both = both.withColumn("weight_change", F.col("current_weight") - F.col("previous_weight"))
    return both.withColumn("status", change_status("previous_weight", "current_weight", tolerance, by_difference))


def explained_changes(reviews: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``changes`` by the difference, with absolute change and share of one-way turnover."""
    move = F.abs("weight_change")
    return changes(reviews, tolerance, True).withColumn("absolute_weight_change", move).withColumn("one_way_turnover_contribution", 0.5 * move)


def target_weight_change(reviews: DataFrame) -> DataFrame:
    g = changes(reviews).groupBy(REVIEW, "previous_effective_date").agg(F.sum(F.abs("weight_change")).alias("gross_target_weight_change"))
    return g.withColumn("one_way_target_weight_change", 0.5 * F.col("gross_target_weight_change"))


def membership_stability(reviews: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Counts, entrants, exits and Jaccard similarity (1 for two empty sets) of each two adjacent reviews."""
    was, is_ = F.col("previous_weight") > tolerance, F.col("current_weight") > tolerance
    g = changes(reviews, tolerance).groupBy(REVIEW, "previous_effective_date").agg(
        F.count_if(was).alias("previous_count"), F.count_if(is_).alias("current_count"), F.count_if(is_ & ~was).alias("entrants"), F.count_if(was & ~is_).alias("exits"),
        F.coalesce(ratio(F.count_if(was & is_), F.count_if(was | is_)), F.lit(1.0)).alias("membership_jaccard"),
    )
    return g


def turnover_decomposition(reviews: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    c = changes(reviews, tolerance).withColumn("absolute_weight_change", F.abs("weight_change"))
    return c.select(REVIEW, "instrument_id", "status", "absolute_weight_change", (0.5 * F.col("absolute_weight_change")).alias("one_way_contribution"))


def contributors(reviews: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``changes`` with each instrument's part of its review's one-way turnover (0 if there is none)."""
    c = changes(reviews, tolerance).withColumn("absolute_weight_change", F.abs("weight_change")).withColumn("one_way_contribution", 0.5 * F.col("absolute_weight_change"))
    total = c.groupBy(REVIEW).agg(F.sum("one_way_contribution").alias("__total"))  # a row a review, not a window over all its rows
    share = F.coalesce(ratio("one_way_contribution", "__total"), F.lit(0.0))
    return c.join(F.broadcast(total), REVIEW).withColumn("share_of_one_way_turnover", share).drop("__total")


def contributors_by_status(reviews: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    return contributors(reviews, tolerance).groupBy(REVIEW, "status").agg(
        F.count_distinct("instrument_id").alias("instrument_count"), F.sum("weight_change").alias("net_weight_change"), F.sum("absolute_weight_change").alias("absolute_weight_change"),
        F.sum("one_way_contribution").alias("one_way_turnover"), F.sum("share_of_one_way_turnover").alias("share_of_one_way_turnover"),
    )


def selection_reasons(reviews: DataFrame, reasons: str = "selection_reason") -> tuple[DataFrame, DataFrame]:
    """Distinct ``(review, instrument, reason)`` rows, blanks left out, and instruments by reason."""
    rows = reviews.select(REVIEW, "instrument_id", F.explode(reasons).alias("reason")).withColumn("reason", F.trim("reason")).where("reason <> ''").distinct()
    return rows, rows.groupBy(REVIEW, "reason").agg(F.count_distinct("instrument_id").alias("instrument_count"))


def explain_tilts(reviews: DataFrame, tilts: Sequence[str], by: Sequence[str] = (REVIEW,), base: str = "benchmark_weight", target: str = "index_weight") -> DataFrame:
    """Each tilt applied in order and normalised: ``(<by>, instrument_id, sequence, step, ...)`` with weights before and after.

    ``residual`` is what is left between the last weight and the target.
    """
    w = Window.partitionBy(*by)
    d = reviews.withColumn("__w0", F.col(base) / F.sum(base).over(w))
    for k, t in enumerate(tilts, 1):
        d = d.withColumn(f"__u{k}", F.col(f"__w{k - 1}") * F.col(t)).withColumn(f"__w{k}", F.col(f"__u{k}") / F.sum(f"__u{k}").over(w))
    last = F.col(target) / F.sum(target).over(w) - F.col(f"__w{len(tilts)}")
    steps = F.array(*[
        F.struct(F.lit(k).alias("sequence"), F.lit(t).alias("step"), F.col(t).cast("double").alias("tilt_multiplier"), F.col(f"__w{k - 1}").alias("previous_weight"), F.col(f"__u{k}").alias("unnormalized_weight"), F.col(f"__w{k}").alias("resulting_weight"))
        for k, t in enumerate(tilts, 1)
    ])
    out = d.withColumn("residual", last).select(*by, "instrument_id", "residual", F.explode(steps).alias("s")).select(*by, "instrument_id", "s.*", "residual")
    change = F.col("resulting_weight") - F.col("previous_weight")
    return out.withColumn("weight_change", change).withColumn("one_way_contribution", 0.5 * F.abs(change))


def frames(reviews: DataFrame) -> DataFrame:
    """Stacked review tables in one form: dates as dates, ids as text without space around, no row twice."""
    d = reviews.withColumns({REVIEW: F.col(REVIEW).cast("date"), "instrument_id": F.trim(F.col("instrument_id").cast("string"))})
    twice = F.count("*").over(Window.partitionBy(REVIEW, "instrument_id")) > 1
    return d.withColumn("instrument_id", F.when(twice, F.raise_error(F.lit("a review has an instrument twice")).cast("string")).otherwise(F.col("instrument_id")))


def normalised_weights(reviews: DataFrame, column: str = "index_weight") -> DataFrame:
    """``(effective_date, instrument_id, weight)`` of what has weight; a null or negative one is an error when it is read."""
    w = F.col(column).cast("double")
    bad = F.raise_error(F.concat(F.lit("weight of "), F.col("instrument_id"))).cast("double")
    return frames(reviews).select(REVIEW, "instrument_id", F.when(w.isNull() | F.isnan(w) | (w < 0), bad).otherwise(w).alias("weight")).where("weight > 0")


def with_inputs(reviews: DataFrame, inputs: DataFrame, values: Sequence[str], column: str = "index_weight") -> DataFrame:
    """Each held name of each review with its row of explicit research inputs ``(effective_date, instrument_id, *values)``.

    One to one: a held name without a row, a row twice, or a null value is an
    error when it is read; rows of names that are not held are left out.
    """
    n = F.count("*").over(Window.partitionBy(REVIEW, "instrument_id"))
    right = inputs.select(REVIEW, "instrument_id", *values).withColumn("__n", n)
    d = normalised_weights(reviews, column).join(right, [REVIEW, "instrument_id"], "left")
    gone = F.col("__n").isNull()
    for c in values:
        gone = gone | F.col(c).isNull()
    said = F.when(F.col("__n") > 1, F.raise_error(F.lit("inputs repeat a name")).cast("double")).when(gone, F.raise_error(F.concat(F.lit("no input for "), F.col("instrument_id"))).cast("double"))
    return d.withColumn("weight", F.coalesce(said, F.col("weight"))).drop("__n")


def nested_rows(value, keys: Sequence[str], at: str = "") -> list[dict]:
    """Rows of tables found anywhere in nested diagnostics under one of ``keys``: mappings and lists are searched, each row names its place."""
    found: list[dict] = []
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{at}.{k}" if at else str(k)
            if k in keys and isinstance(v, list) and all(isinstance(r, dict) for r in v):
                found += [{"path": here, **r} for r in v]
            else:
                found += nested_rows(v, keys, here)
    elif isinstance(value, list | tuple):
        for i, v in enumerate(value):
            found += nested_rows(v, keys, f"{at}[{i}]")
    return found


def disagreement(a: DataFrame, b: DataFrame, column: str = "index_weight", tolerance: float = TOLERANCE) -> DataFrame:
    """``(effective_date, different)``: names whose weights differ between two tables of one run, or that one of them lacks."""
    left, right = (d.select(REVIEW, "instrument_id", F.col(column).alias(name)) for d, name in ((a, "__a"), (b, "__b")))
    d = left.join(right, [REVIEW, "instrument_id"], "full")
    other = F.abs(F.coalesce("__a", F.lit(-1.0)) - F.coalesce("__b", F.lit(-1.0))) > tolerance
    return d.groupBy(REVIEW).agg(F.count_if(other).alias("different"))
