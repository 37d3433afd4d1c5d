"""Scenario shocks, perturbations and their evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Operation(StrEnum):
    ADD = "add"
    MULTIPLY = "multiply"
    REPLACE = "replace"


@dataclass(frozen=True)
class Shock:
    """A change of one field on the rows whose id is listed (if any are) and whose columns have one of the given values."""

    field: str
    operation: Operation
    value: float
    instruments: tuple[str, ...] = ()
    where: Mapping[str, tuple] = field(default_factory=dict)
    allow_empty: bool = False

    def hits(self) -> Column:
        hit = F.lit(True)
        if self.instruments:
            hit = hit & F.col("instrument_id").cast("string").isin(*self.instruments)
        for c, values in self.where.items():
            hit = hit & F.coalesce(F.col(c).isin(*values), F.lit(False))
        return hit

    def new(self) -> Column:
        x = F.col(self.field)
        return {Operation.ADD: x + self.value, Operation.MULTIPLY: x * self.value, Operation.REPLACE: F.lit(self.value)}[self.operation]


@dataclass(frozen=True)
class Scenario:
    name: str
    shocks: tuple[Shock, ...]


def apply(df: DataFrame, scenario: Scenario) -> DataFrame:
    """Shocks in order; each sees what those before it made."""
    for s in scenario.shocks:
        df = df.withColumn(s.field, F.when(s.hits(), s.new()).otherwise(F.col(s.field)))
    return df


def audit(df: DataFrame, scenario: Scenario) -> DataFrame:
    """A row a shock: rows selected, and the mean of their field before and after. One pass for all shocks."""
    cells, d = [], df
    for k, s in enumerate(scenario.shocks):
        hit = s.hits()
        d = d.withColumn(f"__h{k}", hit).withColumn(f"__b{k}", F.when(hit, F.col(s.field))).withColumn(s.field, F.when(hit, s.new()).otherwise(F.col(s.field))).withColumn(f"__a{k}", F.when(hit, F.col(s.field)))
        cells.append(F.struct(F.lit(k).alias("shock_order"), F.lit(s.field).alias("field"), F.lit(str(s.operation)).alias("operation"), F.col(f"n{k}").alias("selected_count"), F.col(f"b{k}").alias("before_mean"), F.col(f"a{k}").alias("after_mean")))
    row = d.agg(*[x for k in range(len(scenario.shocks)) for x in (F.count_if(f"__h{k}").alias(f"n{k}"), F.avg(f"__b{k}").alias(f"b{k}"), F.avg(f"__a{k}").alias(f"a{k}"))])
    return row.select(F.lit(scenario.name).alias("scenario"), F.explode(F.array(*cells)).alias("s")).select("scenario", "s.*")


def require_hits(audited: DataFrame, scenario: Scenario) -> None:
    """ValueError for shocks that select nothing and may not."""
    must = [k for k, s in enumerate(scenario.shocks) if not s.allow_empty]
    empty = audited.where(F.col("shock_order").isin(must) & (F.col("selected_count") == 0)).count() if must else 0
    if empty:
        raise ValueError(f"scenario {scenario.name!r}: {empty} shocks selected no instruments")


def evaluate(df: DataFrame, scenarios: Sequence[Scenario], evaluator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``evaluator`` makes of the base and of each scenario, stacked with its name; all lazy, one plan."""
    out = evaluator(df).withColumn("scenario", F.lit("base"))
    for s in scenarios:
        out = out.unionByName(evaluator(apply(df, s)).withColumn("scenario", F.lit(s.name)))
    return out


def _uniform(seed: int, *parts: Column | str) -> Column:
    """A number in (0, 1) that a row's key alone decides: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def noisy(df: DataFrame, columns: Sequence[str], scale: float, seed: int, keys: Sequence[str] = ("instrument_id",), normal: bool = True, relative: bool = False) -> DataFrame:
    """Columns with seeded noise that depends on a row's key alone: the same however rows are partitioned or recomputed."""
    for c in columns:
        u = [_uniform(seed, F.lit(str(k)), F.lit(c), *keys) for k in (0, 1)]
        z = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1]) if normal else 2 * u[0] - 1
        df = df.withColumn(c, F.col(c) * (1 + scale * z) if relative else F.col(c) + scale * z)
    return df


#: Bins by key hash in which rows are numbered.
BINS = 4096


def drawn(df: DataFrame, seed: int, size: int | None = None, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Exactly ``size`` rows (by default as many as there are) with replacement, each with its number ``draw``.

    Each draw takes a place from a hash of its number; rows have places by bins
    of their key's hash, so no window holds more than a bin. Rows that repeat
    a key are told apart in an order that is not defined. None of an empty table.
    """
    d = df.withColumn("__bin", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(BINS)))
    sizes = d.groupBy("__bin").agg(F.count("*").alias("__n"))  # BINS rows at most
    sizes = sizes.withColumn("__first", F.sum("__n").over(Window.orderBy("__bin")) - F.col("__n"))
    rows = d.withColumn("__at", F.row_number().over(Window.partitionBy("__bin").orderBy(*keys)) - 1).join(F.broadcast(sizes), "__bin")
    rows = rows.withColumn("__p", F.col("__first") + F.col("__at")).drop("__bin", "__n", "__first", "__at")
    n = df.count()
    draws = df.sparkSession.range((n if size is None else size) if n else 0).withColumnRenamed("id", "draw")
    return draws.withColumn("__p", F.pmod(F.xxhash64(F.lit(seed), "draw"), F.lit(max(1, n)))).join(rows, "__p").drop("__p")


def bootstrap(df: DataFrame, seed: int, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """As many rows as there are, drawn with replacement."""
    return drawn(df, seed, None, keys)


@dataclass(frozen=True)
class Outcome:
    name: str
    result: object = None
    error: str | None = None


def run_batch(items: Iterable[tuple[str, Callable[[], object]]], continue_on_error: bool = False) -> list[Outcome]:
    """Runs in order; an error ends them, or is kept as that run's outcome."""
    out = []
    for name, run in items:
        try:
            out.append(Outcome(name, run()))
        except Exception as e:
            if not continue_on_error:
                raise
            out.append(Outcome(name, error=f"{type(e).__name__}: {e}"))
    return out
