"""Connected components over an edge table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of counted, few edges: one task with union-find takes less than the rounds' many small stages."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
        nodes = np.fromiter(above, np.int64, len(above))
        yield pa.record_batch([pa.array(nodes), pa.array([top(x) for x in nodes.tolist()], pa.int64())], ["node", "root"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(resolve, "node long, root long")


def components(edges: DataFrame, most_rounds: int = 60, few: int = BROADCAST_ROWS) -> DataFrame:
    """``(node, root)`` for each node of the undirected ``edges (a, b)``; root is the smallest node reachable.

    Up to ``few`` edges, counted, are resolved in one task. Beyond that,
    alternating large-star and small-star rounds: each joins edges with one
    row per node, so a hub is split by AQE like any skewed join and no
    neighbourhood is gathered. Each round ends in a written table. Null ends
    and self-links are ignored; repeated edges count once; an empty table
    gives none.
    """
    with scratch() as keep:
        now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        before = _state(now)
        if before[0] <= few:
            return keep(written(_at_once(now), "roots"))
        for _ in range(most_rounds):
            if not before[0]:
                break
            now = written(_small_star(_large_star(now)), "stars")
            after = _state(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
        keep(now)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
