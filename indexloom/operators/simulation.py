"""Daily index simulation between reviews, in closed form.

Within a holding segment a weight's drift is its target times a growth that
one running product (or ratio of caps) gives, so there is no day loop and no
carried state: one window over (portfolio, segment, instrument), one sum by
date, and a product over a table with a row a date.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class Phase(StrEnum):
    OPEN = "before_return"
    CLOSE = "after_return"


class Timing(StrEnum):
    NEXT = "next_business_day"
    EXACT = "exact_date"


class Dividends(StrEnum):
    STANDARD = "standard"
    ALTERNATIVE = "alternative"


class Drift(StrEnum):
    PRICE = "price_return"
    RELATIVE_CAP = "relative_capitalization"
    CAP = "capitalization"


class DriftStrategy(Protocol):
    """How a holding's weight mass moves within a segment: an expression over its window ``by``, ordered by date.

    The columns are weight, price_return, market_cap and, if
    ``requires_previous``, ``__cap_before``, the instrument's cap before the date.
    """

    name: str
    requires_previous: bool

    def mass(self, by: WindowSpec) -> Column: ...


@dataclass(frozen=True)
class AbsoluteCap:
    """For replays of old runs: the cap as it is, whatever weight was given, and unchecked."""

    name: str = "absolute_market_cap"
    requires_previous: bool = False

    def mass(self, by: WindowSpec) -> Column:
        return F.col("market_cap")


class Gaps(StrEnum):
    REPORT = "report"
    CARRY = "carry"


KINDS = ("price", "gross_total", "net_total")


def applications(schedule: DataFrame, calendar: DataFrame, timing: Timing = Timing.NEXT) -> DataFrame:
    """``(effective_date, applied_date)``: the first business date on or after each review's date, or that date itself.

    Of reviews before the calendar only the latest applies, on its first
    date. Two reviews on one date are an error, raised when it is found.
    """
    days = calendar.select(F.col("business_date").cast("date").alias("d")).distinct()
    first = F.broadcast(days.agg(F.min("d").alias("__first")))
    s = schedule.select(F.col("effective_date").cast("date").alias("effective_date")).distinct().join(first)
    late = F.max(F.when(F.col("effective_date") <= F.col("__first"), F.col("effective_date"))).over(Window.partitionBy())
    s = s.withColumn("__late", late).where((F.col("effective_date") > F.col("__first")) | (F.col("effective_date") == F.col("__late")))
    s = s.withColumn("__from", F.greatest("effective_date", "__first"))
    if timing == Timing.EXACT:
        out = s.join(days, F.col("d") == F.col("__from")).select("effective_date", F.col("d").alias("applied_date"))
    else:  # a review is a row of a small table: each looks up its date
        out = days.join(F.broadcast(s), F.col("d") >= F.col("__from")).groupBy("effective_date").agg(F.min("d").alias("applied_date"))
    twice = F.count("*").over(Window.partitionBy("applied_date")) > 1
    return out.withColumn("applied_date", F.when(twice, F.raise_error(F.lit("two reviews apply on one business date")).cast("date")).otherwise(F.col("applied_date")))


def segments(calendar: DataFrame, applied: DataFrame, phase: Phase = Phase.OPEN) -> DataFrame:
    """``(business_date, segment)``: the applied date whose weights earn each date's return.

    OPEN: from the applied date to before the next; CLOSE: after it up to the
    next, but the first review applies before the return in either.
    """
    days = calendar.select(F.col("business_date").cast("date").alias("business_date")).distinct()
    marks = days.join(F.broadcast(applied.select(F.col("applied_date").alias("__a")).distinct()), F.col("business_date") == F.col("__a"), "left")
    w = Window.orderBy("business_date")  # a row a date
    upto = F.max("__a").over(w)
    if phase == Phase.CLOSE:
        before = F.max("__a").over(w.rowsBetween(Window.unboundedPreceding, -1))
        upto = F.coalesce(before, upto)
    return marks.select("business_date", upto.alias("segment")).where("segment IS NOT NULL")


def normalised(weights: DataFrame) -> DataFrame:
    """``(portfolio, effective_date, instrument_id, weight)`` with weights that sum to 1 by portfolio and review.

    Totals do not depend on the order in which rows arrive: they add sorted
    weights by a hash of the instrument, then these sums, sorted. So equal
    weights give equal bits, which stored segments are named by.
    """
    by = ("portfolio", "effective_date")
    added = lambda c: F.when(F.size(c) > 0, F.aggregate(F.sort_array(c), F.lit(0.0), lambda a, x: a + x))
    parts = weights.groupBy(*by, F.pmod(F.xxhash64("instrument_id"), F.lit(256))).agg(added(F.collect_list(F.col("weight").cast("double"))).alias("__part"))
    total = parts.groupBy(*by).agg(added(F.collect_list("__part")).alias("__total"))
    return weights.join(total, list(by)).withColumn("weight", F.col("weight") / F.col("__total")).drop("__total")


def both_portfolios(reviews: DataFrame) -> DataFrame:
    """Index and benchmark weights of a review table, stacked."""
    pair = F.array(F.struct(F.lit("index").alias("portfolio"), F.col("index_weight").alias("weight")), F.struct(F.lit("benchmark").alias("portfolio"), F.col("benchmark_weight").alias("weight")))
    return reviews.select("effective_date", "instrument_id", F.explode(pair).alias("p")).select("p.portfolio", "effective_date", "instrument_id", "p.weight")


def carried(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """``panel`` with a row for each instrument and date from its first observation on; where it has none, returns and dividends are 0 and the cap is the last one seen."""
    cells = ("price_return", "gross_dividend", "net_dividend", "market_cap")
    obs = panel.select("instrument_id", F.col("business_date").cast("date").alias("business_date"), *cells)
    days = calendar.agg(F.sort_array(F.collect_set(F.col("business_date").cast("date"))).alias("__days"))  # one row of the calendar
    since = obs.groupBy("instrument_id").agg(F.min("business_date").alias("__since")).join(F.broadcast(days))
    grid = since.select("instrument_id", F.explode(F.filter("__days", lambda d: d >= F.col("__since"))).alias("business_date"))
    d = grid.join(obs, ["instrument_id", "business_date"], "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cells[:3]})
    upto = Window.partitionBy("instrument_id").orderBy("business_date").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("market_cap", F.last("market_cap", True).over(upto))


def held(panel: DataFrame, weights: DataFrame, phase: Phase = Phase.OPEN, timing: Timing = Timing.NEXT, drift: Drift | DriftStrategy = Drift.PRICE, gaps: Gaps = Gaps.REPORT, after=None) -> DataFrame:
    """Each instrument a portfolio holds on each date, with its weight mass before and after the date's return.

    A held instrument without an observation on a date it is held has null
    returns there, which ``checked`` reports, or stands still there if ``gaps``
    are carried (see ``carried``). ``after``: only dates after this one are
    held; what ``panel`` has before, such as a cap, is looked back at.
    """
    calendar = panel.select("business_date").distinct()
    if gaps == Gaps.CARRY:
        panel = carried(panel, calendar)
    calendar = calendar if after is None else calendar.where(F.col("business_date") > F.lit(after).cast("date"))
    applied = applications(weights, calendar, timing)
    days = segments(calendar, applied, phase)
    targets = normalised(weights).join(F.broadcast(applied), "effective_date").withColumnRenamed("applied_date", "segment")
    spine = targets.join(F.broadcast(days), "segment")
    obs = panel.select(F.col("instrument_id"), F.col("business_date").cast("date").alias("business_date"), *[F.col(c) for c in ("price_return", "gross_dividend", "net_dividend", "market_cap")])
    by = Window.partitionBy("portfolio", "segment", "instrument_id").orderBy("business_date")
    own = None if isinstance(drift, Drift) else drift
    if own.requires_previous if own else drift != Drift.PRICE:
        last = F.lag("market_cap").over(Window.partitionBy("instrument_id").orderBy("business_date"))
        obs = obs.withColumn("__cap_before", last)
    d = spine.join(obs, ["instrument_id", "business_date"], "left")
    if own:
        mass = own.mass(by)
    elif drift == Drift.PRICE:
        mass = F.col("weight") * F.product(1 + F.col("price_return")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    elif drift == Drift.RELATIVE_CAP:
        mass = F.col("weight") * F.col("market_cap") / F.first("__cap_before").over(by.rowsBetween(Window.unboundedPreceding, 0))
    else:
        mass = F.when(F.col("weight") > 0, F.col("market_cap")).otherwise(0.0)
    d = d.withColumn("mass", mass)
    before = F.lag("mass").over(by)
    return d.withColumn("first_day", before.isNull()).withColumn("mass_before", F.coalesce(before, "weight"))


def checked(h: DataFrame) -> DataFrame:
    """``h``, after one job that finds held instruments without an observation."""
    gone = h.where("price_return IS NULL").count()
    if gone:
        raise ValueError(f"{gone} held observations are missing")
    return h


def factors(h: DataFrame, dividends: Dividends = Dividends.STANDARD) -> DataFrame:
    """``(portfolio, business_date, price, gross_total, net_total)`` growth factors of each date."""
    m = F.col("mass_before")
    g = h.groupBy("portfolio", "business_date").agg(
        F.sum(m).alias("v"), F.sum(m * (1 + F.col("price_return"))).alias("p"), F.sum(m * F.col("gross_dividend")).alias("g"), F.sum(m * F.col("net_dividend")).alias("n")
    )
    p = F.col("p") / F.col("v")
    total = (lambda d: p / (1 - d)) if dividends == Dividends.STANDARD else (lambda d: p + d)
    return g.select("portfolio", "business_date", p.alias("price"), total(F.col("g") / F.col("v")).alias("gross_total"), total(F.col("n") / F.col("v")).alias("net_total"))


def daily(h: DataFrame, dividends: Dividends = Dividends.STANDARD, base: float = 100.0) -> DataFrame:
    """Returns and levels of index and benchmark, and active returns, a row a date."""
    return levelled(factors(h, dividends), base)


def levelled(f: DataFrame, base: float = 100.0) -> DataFrame:
    """``daily`` of the factors of all dates."""
    wide = f.groupBy("business_date").agg(*[F.max(F.when(F.col("portfolio") == p, F.col(k))).alias(f"{p}_{k}_factor") for p in ("index", "benchmark") for k in KINDS])
    upto = Window.orderBy("business_date").rowsBetween(Window.unboundedPreceding, 0)
    out = wide
    for p in ("index", "benchmark"):
        for k in KINDS:
            out = out.withColumn(f"{p}_{k}_return", F.col(f"{p}_{k}_factor") - 1).withColumn(f"{p}_{k}_level", base * F.product(f"{p}_{k}_factor").over(upto)).drop(f"{p}_{k}_factor")
    for k in KINDS:
        out = out.withColumn(f"active_{k}_return", F.col(f"index_{k}_return") - F.col(f"benchmark_{k}_return"))
    return out


def weights_by_date(h: DataFrame) -> DataFrame:
    """``h`` with opening and closing weights; totals are a row a portfolio and date."""
    totals = h.groupBy("portfolio", "business_date").agg(F.sum("mass_before").alias("__b"), F.sum("mass").alias("__a"))
    d = h.join(totals, ["portfolio", "business_date"])
    return d.withColumn("opening_weight", F.col("mass_before") / F.col("__b")).withColumn("closing_weight", F.col("mass") / F.col("__a")).drop("__a", "__b")


def holdings(h: DataFrame) -> DataFrame:
    """Opening and closing weights of index and benchmark by date and instrument of either, 0 where not held."""
    w = weights_by_date(h)
    cells = [F.coalesce(F.max(F.when(F.col("portfolio") == p, F.col(f"{s}_weight"))), F.lit(0.0)).alias(f"{p}_{s}_weight") for p in ("index", "benchmark") for s in ("opening", "closing")]
    return w.groupBy("business_date", "instrument_id").agg(*cells)


def boundary(h: DataFrame) -> DataFrame:
    """At each applied date but the first: what is held before and after, by portfolio and instrument.

    Before is the closing weight of the segment that ends there. One pass over
    ``h``: each instrument's target and last mass of each segment; totals and
    the next segment come from that.
    """
    by = ("portfolio", "segment")
    ends = h.groupBy(*by, "instrument_id").agg(F.max_by("mass", "business_date").alias("mass"), F.max("weight").alias("target"))
    last = ends.groupBy(*by).agg(F.sum("mass").alias("__total"))
    order = ends.select("segment").distinct().withColumn("__next", F.lead("segment").over(Window.orderBy("segment"))).where("__next IS NOT NULL")  # a row a segment
    old = ends.join(last, list(by)).join(order, "segment")
    old = old.select("portfolio", F.col("__next").alias("applied_date"), "instrument_id", (F.col("mass") / F.col("__total")).alias("pre_rebalance"))
    new = ends.select("portfolio", F.col("segment").alias("applied_date"), "instrument_id", "target").join(order.select(F.col("__next").alias("applied_date")), "applied_date")
    both = old.join(new, ["portfolio", "applied_date", "instrument_id"], "full")
    return both.select("portfolio", "applied_date", "instrument_id", F.coalesce("pre_rebalance", F.lit(0.0)).alias("pre_rebalance"), F.coalesce("target", F.lit(0.0)).alias("target"))


def rebalances(h: DataFrame) -> DataFrame:
    """One-way turnover of index and benchmark at each applied date; null at the first, which has nothing before."""
    b = boundary(h).groupBy("applied_date").agg(*[(0.5 * F.sum(F.when(F.col("portfolio") == p, F.abs(F.col("target") - F.col("pre_rebalance"))).otherwise(0.0))).alias(f"{p}_turnover") for p in ("index", "benchmark")])
    all_ = h.groupBy(F.col("effective_date").alias("scheduled_effective_date"), F.col("segment").alias("applied_date")).agg(F.count_distinct("instrument_id").alias("instrument_count"))
    return all_.join(b, "applied_date", "left")


def snapshots(h: DataFrame) -> DataFrame:
    """``(applied_date, snapshot, instrument_id, index_weight, benchmark_weight)``: before, target and end of day of each rebalance."""
    b = boundary(h)
    w = weights_by_date(h).where(F.col("business_date") == F.col("segment")).select("portfolio", F.col("segment").alias("applied_date"), "instrument_id", F.col("closing_weight").alias("weight"), F.lit("end_of_day").alias("snapshot"))
    kinds = F.array(*[F.struct(F.lit(k).alias("snapshot"), F.col(k).alias("weight")) for k in ("pre_rebalance", "target")])
    long = b.select("portfolio", "applied_date", "instrument_id", F.explode(kinds).alias("s")).select("portfolio", "applied_date", "instrument_id", "s.weight", "s.snapshot")
    cells = [F.coalesce(F.max(F.when(F.col("portfolio") == p, F.col("weight"))), F.lit(0.0)).alias(f"{p}_weight") for p in ("index", "benchmark")]
    return long.unionByName(w).groupBy("applied_date", "snapshot", "instrument_id").agg(*cells)


def fixed_weight_returns(panel: DataFrame, weights: DataFrame, dividends: Dividends = Dividends.STANDARD) -> DataFrame:
    """Factors of each date with the same ``(instrument_id, weight)`` on all dates: a broadcast only if the engine finds them small."""
    total = F.broadcast(weights.agg(F.sum("weight").alias("__t")))
    w = weights.join(total).select("instrument_id", (F.col("weight") / F.col("__t")).alias("mass_before"))
    return factors(panel.join(w, "instrument_id").withColumn("portfolio", F.lit("index")), dividends).drop("portfolio")


def rebased(d: DataFrame, start, base: float = 100.0) -> DataFrame:
    """Rows of ``daily`` from ``start`` on, levels starting from ``base`` there."""
    d = d.where(F.col("business_date") >= F.lit(start))
    w = Window.orderBy("business_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in [c for c in d.columns if c.endswith("_level")]:
        r = c[: -len("level")] + "return"
        d = d.withColumn(c, F.col(c) * base * (1 + F.first(r).over(w)) / F.first(c).over(w))
    return d


#: Days of the calendar by which a run that starts late looks back for a cap.
LOOK_BACK_DAYS = 14


def look_back(start, drift: Drift = Drift.PRICE, days: int = LOOK_BACK_DAYS) -> Column:
    """The first date to ask market data for: ``days`` before ``start`` where the drift needs an earlier cap."""
    d = F.lit(start).cast("date")
    return F.date_sub(d, days) if drift != Drift.PRICE else d


def seed_start(schedule: DataFrame, start) -> DataFrame:
    """One row ``(seed_date)``: the second-latest review up to ``start`` (the latest if it is alone), from which a run that starts there is replayed."""
    past = schedule.select("effective_date").distinct().where(F.col("effective_date") <= F.lit(start).cast("date"))
    last = F.sort_array(F.collect_list("effective_date"), asc=False)  # a row a review
    return past.agg(last.alias("__d")).select(F.coalesce(F.get("__d", F.lit(1)), F.get("__d", F.lit(0))).alias("seed_date"))


def replayed(d: DataFrame, start, base: float = 100.0) -> DataFrame:
    """``daily`` of a run that began at its seed: rows from ``start`` on, levels from ``base`` there."""
    return rebased(d, start, base)


def checkpoint(h: DataFrame, d: DataFrame, date) -> DataFrame:
    """State after ``date``: closing weights by portfolio and instrument, with that date's levels."""
    levels = d.where(F.col("business_date") == F.lit(date).cast("date")).select(*[c for c in d.columns if c.endswith("_level")])
    w = weights_by_date(h).where(F.col("business_date") == F.lit(date).cast("date")).select("business_date", "portfolio", "instrument_id", "closing_weight")
    return w.join(F.broadcast(levels))  # one row


def decoded(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a checkpoint: its weights as targets ``(portfolio, effective_date, instrument_id, weight)``, and its one row of levels."""
    w = state.select("portfolio", F.col("business_date").alias("effective_date"), "instrument_id", F.col("closing_weight").alias("weight"))
    return w, state.select("business_date", *[c for c in state.columns if c.endswith("_level")]).distinct()


def resumed(state: DataFrame, panel: DataFrame, weights: DataFrame, dividends: Dividends = Dividends.STANDARD, **how) -> DataFrame:
    """``daily`` after a checkpoint's date, going on from its weights and levels as if the run had never stopped.

    Reviews after that date apply as ever; until the first of them the
    checkpoint's weights drift on. Weights must have the state's portfolios.
    """
    targets, levels = decoded(state)
    held_at = levels.select("business_date").first()
    if held_at is None:
        raise ValueError("the checkpoint is empty")
    date = held_at[0]
    later = weights.where(F.col("effective_date").cast("date") > F.lit(date))
    first = panel.where(F.col("business_date").cast("date") > F.lit(date)).agg(F.min("business_date").cast("date")).first()[0]
    if first is not None and not later.where(F.col("effective_date").cast("date") <= F.lit(first)).isEmpty():
        both = later.select("portfolio", "effective_date", "instrument_id", "weight")  # a review applies at once
    else:
        both = later.select("portfolio", F.col("effective_date").cast("date").alias("effective_date"), "instrument_id", "weight").unionByName(targets.select("portfolio", F.col("effective_date").cast("date").alias("effective_date"), "instrument_id", "weight"))
    d = daily(held(panel, both, after=date, **how), dividends, 1.0)
    start = F.broadcast(levels.drop("business_date").select(*[F.col(c).alias(f"__{c}") for c in levels.columns if c.endswith("_level")]))
    d = d.join(start)
    return d.withColumns({c[2:]: F.col(c[2:]) * F.col(c) for c in d.columns if c.startswith("__")}).drop(*[c for c in d.columns if c.startswith("__")])


def combined(parts: list[DataFrame]) -> DataFrame:
    """Daily tables of consecutive runs on top of each other; a date that two of them have is an error when it is read."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = F.count("*").over(Window.partitionBy("business_date")) > 1
    date = F.when(twice, F.raise_error(F.lit("two runs have one business date")).cast("date")).otherwise(F.col("business_date"))
    return out.withColumn("business_date", date)
