"""Loading rules: functions from a review table to a review table, composed with ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[DataFrame], DataFrame]
REVIEW = "effective_date"


def composed(*rules: Rule) -> Rule:
    """Rules one after another."""
    return lambda df: reduce(lambda d, rule: rule(d), rules, df)


def universe_defaults(df: DataFrame) -> DataFrame:
    """Index weights start as benchmark weights, nothing excluded, no reasons."""
    have = lambda c, otherwise: F.coalesce(F.col(c), otherwise) if c in df.columns else otherwise
    none = F.array().cast("array<string>")
    return df.withColumns({"index_weight": have("index_weight", F.col("benchmark_weight")), "excluded": have("excluded", F.lit(False)), "exclusion_reason": have("exclusion_reason", none)})


def total_returns(market: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Market data up to the cutoff with gross and net total returns: price return plus dividend."""
    m = market.where(F.col("business_date") <= F.lit(cutoff).cast("date")) if cutoff else market
    return m.withColumn("gross_total_return", F.col("price_return") + F.col("gross_dividend")).withColumn("net_total_return", F.col("price_return") + F.col("net_dividend"))


def add_facts(facts: DataFrame, fields: Sequence[str] | None = None, by: Sequence[str] = ("instrument_id",)) -> Rule:
    """Left join of facts by instrument; each key has one row of facts, or reading it fails."""
    fields = list(fields or [c for c in facts.columns if c not in by])
    n = F.count("*").over(Window.partitionBy(*by))
    f = facts.select(*by, *fields).withColumn("__n", n)
    f = f.withColumn(fields[0], F.when(F.col("__n") > 1, F.raise_error(F.lit("facts repeat a key")).cast(dict(f.dtypes)[fields[0]])).otherwise(F.col(fields[0]))).drop("__n")
    return lambda df: df.drop(*fields).join(f, list(by), "left")


def unknown_instruments(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Instruments of ``facts`` that the table does not have."""
    return facts.select("instrument_id").distinct().join(df.select("instrument_id").distinct(), "instrument_id", "left_anti")


def add_memberships(members: DataFrame, indexes: Iterable[str]) -> Rule:
    """A boolean column an index, from ``members (index_id, instrument_id, is_member)``; false where nothing is said."""
    names = list(indexes)
    wide = members.groupBy("instrument_id").agg(*[F.bool_or((F.col("index_id") == i) & F.col("is_member")).alias(i) for i in names])
    return lambda df: df.drop(*names).join(wide, "instrument_id", "left").fillna(False, names)


def add_third_party(data: DataFrame, fields: Sequence[str], observed: str = "observation_date") -> Rule:
    """Left join of the latest observation on or before each review's reference date."""
    fields = list(fields)

    def rule(df: DataFrame) -> DataFrame:
        refs = F.broadcast(df.select(REVIEW, "reference_date").distinct())  # a row a review
        seen = data.join(refs, F.col(observed) <= F.col("reference_date"))
        last = seen.groupBy(REVIEW, "instrument_id").agg(F.max_by(F.struct(*fields, observed), observed).alias("__f")).select(REVIEW, "instrument_id", "__f.*")
        return df.drop(*fields, observed).join(last, [REVIEW, "instrument_id"], "left")

    return rule


def imported(data: DataFrame, fields: Sequence[str], date: str, by: Sequence[str] = ("instrument_id",)) -> Rule:
    """Left join, for each review, of the one latest set of rows whose date is not after the reference date."""
    fields = list(fields)

    def rule(df: DataFrame) -> DataFrame:
        refs = df.select(REVIEW, "reference_date").distinct()
        dates = data.select(F.col(date).alias("__d")).distinct()
        latest = refs.join(dates, F.col("__d") <= F.col("reference_date")).groupBy(REVIEW).agg(F.max("__d").alias("__d"))
        rows = data.select(*by, *fields, F.col(date).alias("__d")).join(F.broadcast(latest), "__d").drop("__d")
        return df.drop(*fields).join(rows, [REVIEW, *by], "left")

    return rule


@dataclass(frozen=True)
class Exclusion:
    """Names to leave out (``exclude``) or alone to keep (``only_include``), by values of a column."""

    column: str
    values: tuple
    reason: str
    only_include: bool = False

    def hits(self) -> Column:
        inside = F.coalesce(F.col(self.column).isin(*self.values), F.lit(False))
        return ~inside if self.only_include else inside


def exclude(rules: Sequence[Exclusion], weight: str = "index_weight", by: Sequence[str] = (REVIEW,)) -> Rule:
    """Marks excluded names with all their reasons, sets their weight to 0 and spreads the rest to sum to 1 by review."""

    def rule(df: DataFrame) -> DataFrame:
        new = F.array_compact(F.array(*[F.when(r.hits(), F.lit(r.reason)) for r in rules]))
        d = df.withColumn("exclusion_reason", F.concat(F.coalesce("exclusion_reason", F.array().cast("array<string>")), new))
        d = d.withColumn("excluded", F.coalesce("excluded", F.lit(False)) | (F.size("exclusion_reason") > 0))
        d = d.withColumn(weight, F.when(F.col("excluded"), 0.0).otherwise(F.col(weight)))
        return d.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy(*by)))

    return rule


def exclusion_violations(df: DataFrame, weight: str = "index_weight", tolerance: float = 1e-8) -> DataFrame:
    """Excluded names that still have weight."""
    return df.where(F.col("excluded") & (F.col(weight) > tolerance)).select(REVIEW, "instrument_id", weight, "exclusion_reason")


def visible(df: DataFrame, columns: Sequence[str] | None = None, excluded_too: bool = False) -> DataFrame:
    """Chosen columns, without excluded names unless asked for."""
    d = df if excluded_too or "excluded" not in df.columns else df.where(~F.coalesce("excluded", F.lit(False)))
    return d.select(*columns) if columns else d


def upserted(df: DataFrame, update: DataFrame, columns: Sequence[str], by: Sequence[str] = (REVIEW, "instrument_id")) -> DataFrame:
    """``df`` with columns replaced where ``update`` has the key, nulls too; keys that ``df`` lacks are an error when read."""
    marked = df.withColumn("__mine", F.lit(True))
    u = update.select(*by, F.lit(True).alias("__u"), *[F.col(c).alias(f"__{c}") for c in columns])
    d = marked.join(u, list(by), "full")
    kinds = dict(df.dtypes) | {c: k for c, k in update.dtypes if c not in df.columns}
    old: Mapping[str, Column] = {c: F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]) for c in columns}
    d = d.withColumns({c: F.when(F.col("__u"), F.col(f"__{c}")).otherwise(old[c]) for c in columns})
    unknown = F.raise_error(F.lit("update has unknown keys")).cast("boolean")
    return d.where(F.when(F.col("__mine").isNull(), unknown).otherwise(True)).drop("__mine", "__u", *[f"__{c}" for c in columns])


def latest_before(market: DataFrame, date: str) -> DataFrame:
    """The last cross-section strictly before a date."""
    past = market.where(F.col("business_date") < F.lit(date).cast("date"))
    last = F.broadcast(past.agg(F.max("business_date").alias("__d")))
    return past.join(last, F.col("business_date") == F.col("__d")).drop("__d")
