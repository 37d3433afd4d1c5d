"""Return statistics, transitions and rank tests by regime."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import YEAR_DAYS, annualised_return, annualised_volatility, chi_square_tail, compound, normal_cdf


def long_returns(df: DataFrame, columns: Sequence[str], date: str = "business_date") -> DataFrame:
    """``(business_date, series, return)`` of a wide table of return columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("return")) for c in columns])
    return df.select(date, F.explode(pairs).alias("p")).select(date, "p.*")


def statistics(returns: DataFrame, regimes: DataFrame, year: int = YEAR_DAYS) -> DataFrame:
    """By regime and series, over dates that have both: drawdowns run within a regime's own dates."""
    d = returns.join(regimes, "business_date").where("`return` IS NOT NULL AND regime IS NOT NULL")
    r = F.col("return")
    w = Window.partitionBy("regime", "series").orderBy("business_date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__level", F.product(1 + r).over(w)).withColumn("__drawdown", F.col("__level") / F.max("__level").over(w) - 1)
    low = F.when(r < 0, r).otherwise(0.0)
    g = d.groupBy("regime", "series").agg(
        F.count("*").alias("observations"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), compound(r).alias("total_return"), annualised_volatility(r, year).alias("annualized_volatility"),
        (F.sqrt(F.avg(low * low)) * math.sqrt(year)).alias("downside_deviation"), F.min("__drawdown").alias("maximum_drawdown"), F.avg((r > 0).cast("double")).alias("positive_return_ratio"),
    )
    return g.withColumn("annualized_return", annualised_return("total_return", "observations", year))


def transitions(regimes: DataFrame) -> DataFrame:
    """Counts and probabilities of each label after each other label; a label that nothing follows has probabilities 0."""
    r = regimes.where("regime IS NOT NULL").select("business_date", F.col("regime").cast("string").alias("to_regime"))
    steps = r.withColumn("from_regime", F.lag("to_regime").over(Window.orderBy("business_date"))).where("from_regime IS NOT NULL")
    counts = steps.groupBy("from_regime", "to_regime").agg(F.count("*").alias("n"))
    labels = steps.select(F.explode(F.array("from_regime", "to_regime")).alias("label")).agg(F.sort_array(F.collect_set("label")).alias("labels"))  # one row of distinct labels
    grid = labels.select(F.explode("labels").alias("from_regime"), "labels").select("from_regime", F.explode("labels").alias("to_regime"))
    full = grid.join(counts, ["from_regime", "to_regime"], "left").withColumn("transitions", F.coalesce("n", F.lit(0)))
    total = F.sum("transitions").over(Window.partitionBy("from_regime"))
    return full.select("from_regime", "to_regime", "transitions", F.when(total > 0, F.col("transitions") / total).otherwise(0.0).alias("probability"))


def _ranked(d: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average ranks of ``return`` within ``by``, and the sum of t^3 - t over its ties."""
    w = Window.partitionBy(*by).orderBy("return")
    tie = F.count("*").over(Window.partitionBy(*by, "return"))
    return d.withColumn("__rank", F.rank().over(w) + (tie - 1) / 2).withColumn("__ties", (tie * tie - 1).cast("double"))


def distribution_tests(returns: DataFrame, regimes: DataFrame) -> DataFrame:
    """Kruskal-Wallis over all regimes and two-sided Mann-Whitney U of each two, by series; normal approximation with ties and continuity."""
    d = returns.join(regimes, "business_date").where("`return` IS NOT NULL AND regime IS NOT NULL").select("series", F.col("regime").cast("string").alias("regime"), "return")
    k = _ranked(d, ["series"]).groupBy("series", "regime").agg(F.count("*").alias("n"), F.sum("__rank").alias("r"), F.sum("__ties").alias("ties"))
    k = k.groupBy("series").agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("ties").alias("ties"), F.count("*").alias("k")).where("k >= 2")
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    k = k.select("series", F.lit("kruskal_wallis").alias("test"), F.lit(None).cast("string").alias("regime_a"), F.lit(None).cast("string").alias("regime_b"), h.alias("statistic"), (F.col("k") - 1).alias("df"))
    k = k.withColumn("p_value", chi_square_tail("statistic", "df")).drop("df")
    pairs = d.select("regime").distinct().alias("x").join(d.select("regime").distinct().alias("y"), F.col("x.regime") < F.col("y.regime")).select(F.col("x.regime").alias("regime_a"), F.col("y.regime").alias("regime_b"))
    two = d.join(pairs.select("regime_a", "regime_b", F.explode(F.array("regime_a", "regime_b")).alias("regime")), "regime")
    by = ["series", "regime_a", "regime_b"]
    is_a = F.col("regime") == F.col("regime_a")
    m = _ranked(two, by).groupBy(*by).agg(F.count_if(is_a).cast("double").alias("na"), F.count_if(~is_a).cast("double").alias("nb"), F.sum(F.when(is_a, F.col("__rank"))).alias("ra"), F.sum("__ties").alias("ties"))
    na, nb = F.col("na"), F.col("nb")
    u = F.col("ra") - na * (na + 1) / 2
    n = na + nb
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sd
    m = m.select("series", F.lit("mann_whitney_u").alias("test"), "regime_a", "regime_b", u.alias("statistic"), z.alias("z"))
    m = m.withColumn("p_value", F.least(F.lit(1.0), 2 * normal_cdf(-F.col("z")))).drop("z")
    return k.unionByName(m)
