"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. The driver sees one row of sums a round, never the
sources; documents are decided on by a source's own row and a hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hex digits of the hash order by which a source's words are counted before its turning point is looked up row by row.
PREFIX = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_: Column, seed: int = SEED) -> Column:
    """A row's place in the seeded order of its source: md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources (source, ...)`` with ``rank`` from 0 by code point, null last: ranges, then an offset for each range."""
    by = F.col("source").asc_nulls_last()
    ranged = written(sources.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(sizes), "part").withColumn("rank", F.col("offset") + F.col("within")).drop("part", "within", "offset")


def water_fill(sources: DataFrame, budget: int | None = None) -> DataFrame:
    """``sources (weight, cap, size, ...)`` with ``whole`` repetitions of each, ``part`` words of one more and the ``target``.

    Each round clamps the sources whose share by weight is at least their cap
    and shares out what they leave; shares only grow, so a round without a new
    clamp is the end. ``budget``: words to share, by default all sizes. Where
    caps sum to less, each source gets its cap. Integers throughout.
    """
    big = "decimal(38,0)"
    total, weights = sources.agg(F.sum("size"), F.sum("weight")).first()
    budget = (total or 0) if budget is None else budget
    left, free, clamped = budget, weights or 0, -1
    while True:
        is_full = F.col("cap").cast(big) * F.lit(free).cast(big) <= F.lit(left).cast(big) * F.col("weight").cast(big)
        n, used, w = sources.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("cap"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == clamped or not w:
            break
        clamped, left, free = n, budget - (used or 0), w
    share = F.lit(left).cast(big) * F.col("weight").cast(big)
    size = F.lit(free).cast(big) * F.col("size").cast(big)
    whole = F.when(is_full, F.floor(F.col("cap") / F.col("size"))).otherwise(F.call_function("div", share, size))
    target = F.when(is_full, F.col("cap").cast("double")).otherwise(share.cast("double") / F.lit(float(free)))
    whole = F.when(F.col("size") == 0, F.lit(0)).otherwise(whole).cast("long")
    return sources.withColumn("target", target).withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("size"))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """One row a source: size, target, whole repetitions, and where in hash order the fractional one turns from all to none.

    ``rows (source, size, key)``. Weights go to sources by code point, null
    last, repeating.
    """
    sources = _ranked(rows.groupBy("source").agg(F.sum("size").alias("size")))
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    sources = sources.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    sources = written(water_fill(sources.withColumn("cap", F.col("size") * max_epochs), budget), "targets")
    bins = rows.groupBy("source", F.substring("key", 1, PREFIX).alias("bin")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("after", F.sum("words").over(upto))
    # the first bin that ends beyond the words wanted; none if all bins fit
    parts = sources.select(F.col("source").alias("s"), F.col("part").alias("wanted"))
    crossing = bins.join(parts, F.col("source").eqNullSafe(F.col("s"))).where(F.col("after") > F.col("wanted"))
    crossing = crossing.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bin", (F.col("after") - F.col("words")).alias("before"))).alias("at"))
    plan = sources.join(crossing, F.col("source").eqNullSafe(F.col("s")), "left")
    return written(plan.select("source", F.col("size").alias("source_size"), "target", "whole", "part", "at.bin", "at.before"), "mix")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows (source, size, key, ...)`` with source_size, target and ``copies``, the whole number of times the mix takes each.

    A row is taken once more than its source's whole repetitions if it lies,
    by its middle word, before the turning point of its source's hash order.
    Only rows of the one bin that holds the point (1 in 4,096 of a source) are
    ordered one by one.
    """
    plan = small(plan.withColumnRenamed("source", "__s"), plan.count())
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    at = F.substring("key", 1, PREFIX)
    clear = rows.where(F.col("bin").isNull() | (at != F.col("bin")))
    clear = clear.withColumn("__more", F.col("bin").isNull() & (F.col("part") > 0) | F.coalesce(at < F.col("bin"), F.lit(False)))
    near = rows.where(at == F.col("bin"))
    upto = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    near = near.withColumn("__more", 2 * gone + F.col("size") <= 2 * F.col("part"))
    both = clear.unionByName(near)
    return both.withColumn("copies", F.col("whole") + F.col("__more").cast("long")).drop("whole", "part", "bin", "before", "__more")


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` as ``(doc_id, source, size, key)``; other columns are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order_key(F.col(id_col), seed).alias("key"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs``; texts are read once.

    Null texts have size 0 and are taken 0 words; null sources are one source,
    the last; null ids share one place in the order, as repeated ids do;
    an empty table gives none. ``how``: weights, max_epochs, budget.
    """
    rows = written(prepared(docs, id_col, text_col, source_col, seed), "sizes")
    taken = take(rows, plan_mix(rows, **how))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as it is taken (see ``mix_sizes``)."""
    plan = plan_mix(written(prepared(docs, id_col, text_col, source_col, seed), "sizes"), **how)
    held = docs.select(F.struct("*").alias("doc"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order_key(F.col(id_col), seed).alias("key"))
    taken = take(held, plan).where(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
