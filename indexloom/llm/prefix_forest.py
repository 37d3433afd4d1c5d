"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has in each tree a long string of symbols: each symbol names the
largest of a few randomly rotated coordinates and its sign (4 bits). Blocks of
rows keep, for each tree, their strings sorted. A query descends in every tree
to the strings that share its longest prefixes and ascends all trees at once,
symbol by symbol, until enough candidates are below it and ``k`` other rows among
them; those are compared exactly, in double precision.

How many are enough is measured: on a bounded sample of queries, brute force
over all rows gives the true neighbours, and the fewest candidates are taken
that hold ``recall`` of them. Queries meet rows block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TREES, SYMBOLS, SPAN, SEED = 64, 8, 8, 3
BITS = 4  # of a symbol: one of SPAN coordinates, and a sign
#: Rows of an index block; queries of a query block.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 1_024
#: Blocks in a row group of their table: what its writer and its reader hold at once.
GROUP_BLOCKS = 2
#: Rows from which the centre is taken; queries on which the number of candidates is measured.
FIT_ROWS, FIT_QUERIES = 4_096, 128
RECALL = 0.96


@cache
def _rotations(dim: int, seed: int) -> np.ndarray:
    """``(dim, TREES * SYMBOLS * SPAN)``: SPAN orthogonal directions for each symbol, as far as ``dim`` goes."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :SPAN] for _ in range(TREES * SYMBOLS)], axis=1)


def strings(x: np.ndarray, centre: np.ndarray, seed: int = SEED) -> np.ndarray:
    """``(rows, TREES)`` uint32: the symbols of each tree, first symbol highest."""
    out = np.zeros((len(x), TREES), np.uint32)
    r = _rotations(x.shape[1], seed)
    span = r.shape[1] // (TREES * SYMBOLS)
    for at in range(0, len(x), 1024):
        y = ((x[at : at + 1024] - centre) @ r).reshape(-1, TREES, SYMBOLS, span)
        k = np.abs(y).argmax(3)
        sign = np.take_along_axis(y, k[..., None], 3)[..., 0] > 0
        symbol = (2 * k + sign).astype(np.uint32)
        for s in range(SYMBOLS):
            out[at : at + 1024] |= symbol[:, :, s] << np.uint32(BITS * (SYMBOLS - 1 - s))
    return out


def _valid(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of those rows that take part."""
    vectors = vectors.filter(ids.is_valid())
    ids = ids.filter(ids.is_valid())
    ok = np.array([v.is_valid and len(v) == dim and v.values.null_count == 0 for v in vectors], bool)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros((0, dim))
    x = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    held = ids.filter(pa.array(ok)).to_numpy(zero_copy_only=False).astype(np.int64)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return held[good], x[good]


_ROWS = "ids binary, vectors binary, strings binary, places binary"


def _packed(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, ordered: bool) -> pa.RecordBatch:
    """A block; ``places`` has each tree's rows in the order of their strings, for blocks that are searched."""
    places = np.argsort(codes, axis=0, kind="stable").astype(np.uint16) if ordered else np.zeros(0, np.uint16)
    cells = [pa.array([c.tobytes()], pa.binary()) for c in (ids, x, codes, places)]
    return pa.record_batch(cells, ["ids", "vectors", "strings", "places"])


def _blocks(rows: DataFrame, dim: int, centre: np.ndarray, size: int, seed: int, ordered: bool = False) -> DataFrame:
    """Rows of ``(vec_id, vector)`` as blocks of up to ``size``, with their strings."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), np.zeros((0, dim))
        for batch in batches:
            more = _valid(batch.column(0), batch.column(1), dim)
            ids, x = np.concatenate([ids, more[0]]), np.concatenate([x, more[1]])
            while len(ids) >= size:
                yield _packed(ids[:size], x[:size], strings(x[:size], centre, seed), ordered)
                ids, x = ids[size:], x[size:]
        if len(ids):
            yield _packed(ids, x, strings(x, centre, seed), ordered)

    return rows.mapInArrow(of, _ROWS)


class _Block:
    def __init__(self, ids: bytes, vectors: bytes, codes: bytes, dim: int, places: bytes = b"") -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.codes = np.frombuffer(codes, np.uint32).reshape(-1, TREES)
        if places:
            self.order = np.frombuffer(places, np.uint16).reshape(-1, TREES)
            self.sorted = np.take_along_axis(self.codes, self.order.astype(np.int64), 0)

    def spans(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the part of its sorted array that shares the first ``level`` symbols."""
        shift = np.uint64(BITS * (SYMBOLS - level))
        low = (codes.astype(np.uint64) >> shift) << shift
        high = low + (np.uint64(1) << shift)
        ends = [np.stack([np.searchsorted(self.sorted[:, t], v[:, t]) for t in range(TREES)], 1) for v in (low, high)]
        return ends[0], ends[1]


def nearest(query: int, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the ``k`` nearest, the query's own id left out, each id once, ties to the smaller."""
    dist = np.sqrt(((rows - x) ** 2).sum(1))
    other = ids != query
    dist, ids = dist[other], ids[other]
    if len(ids) > 4 * k:
        near = dist <= np.partition(dist, 4 * k)[4 * k]
        if len(np.unique(ids[near])) >= k:
            dist, ids = dist[near], ids[near]
    by = np.lexsort((ids, dist))
    _, first = np.unique(ids[by], return_index=True)
    by = by[np.sort(first)[:k]]
    return dist[by], ids[by]


def _met(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Each query block beside each index block, by a product of the two tables' partitions.

    The hint keeps the planner from broadcasting either side: pairs stream
    from the two tables as they are read, nothing of them passes the driver
    and nothing is shuffled.
    """
    searched = index.select(*[F.col(c).alias(f"r_{c}") for c in ("ids", "vectors", "strings", "places")])
    return searched.crossJoin(queries.drop("places").hint("shuffle_replicate_nl"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id of ``queries`` its ``k`` nearest among the rows of ``vectors``.

    Both have id and vector. score: Euclidean distance; a query's own id is
    no candidate; ties go to the smaller id; an id that repeats stands for all
    its rows, the nearest counting. Rows with a null id, and vectors null,
    empty, zero, of another length than most, or with null or non-finite
    components take no part. Fewer candidates than ``k``: all. Empty tables
    give none. Extra columns are not read.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    lengths = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], out)
    dim = lengths["n"]
    fit = rows.where(F.size("v") == dim).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    sample = _valid(fit.column(0).combine_chunks(), fit.column(1).combine_chunks(), dim)[1]
    centre = sample.mean(0) if len(sample) else np.zeros(dim)
    index = written(_blocks(rows, dim, centre, BLOCK_ROWS, seed, ordered=True), "index", GROUP_BLOCKS)
    asked = written(_blocks(asked.dropDuplicates(), dim, centre, BLOCK_QUERIES, seed), "queries", GROUP_BLOCKS)
    picked = queries.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(FIT_QUERIES)
    tried = np.array([r["id"] for r in picked.collect()], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = _Block(r["r_ids"], r["r_vectors"], r["r_strings"], dim, r["r_places"])
                q = _Block(r["ids"], r["vectors"], r["strings"], dim)
                n = np.stack([np.subtract(*block.spans(q.codes, level)[::-1]).sum(1) for level in range(SYMBOLS + 1)], 1)
                near: list[list] = [[] for _ in q.ids]
                for i in np.flatnonzero(np.isin(q.ids, tried)):
                    dist, ids = nearest(q.ids[i], q.x[i], block.ids, block.x, k)
                    for d, v in zip(dist, ids):
                        # the deepest level at which some tree of some row of this id meets the query
                        same = block.codes[block.ids == v] ^ q.codes[i]
                        level = max(s for s in range(SYMBOLS + 1) if s == 0 or (same >> np.uint32(BITS * (SYMBOLS - s)) == 0).any())
                        near[i].append({"score": float(d), "vec_id": int(v), "level": level})
                kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("level", pa.int32())]))
                yield pa.record_batch([pa.array(q.ids), pa.array(list(n.astype(np.int64)), pa.list_(pa.int64())), pa.array(near, kind)], ["query_id", "n", "near"])

    seen = written(_met(asked, index).mapInArrow(count, "query_id long, n array<long>, near array<struct<score:double,vec_id:long,level:int>>"), "levels")
    counts = written(seen.groupBy("query_id").agg(*[F.sum(F.get("n", F.lit(s))).alias(f"n{s}") for s in range(SYMBOLS + 1)]), "counts")
    near = seen.select("query_id", F.explode("near").alias("x")).select("query_id", "x.*").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.max("level").alias("level"))
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    truth = best.join(counts, "query_id").collect()  # FIT_QUERIES times k rows at most
    enough = _enough(truth, recall)
    deepest = F.lit(0)
    for s in range(1, SYMBOLS + 1):
        deepest = F.when(F.col(f"n{s}") >= enough, s).otherwise(deepest)
    levels = counts.select(F.col("query_id"), deepest.alias("level"))
    # the level of each query goes back into its block
    flat = asked.select(F.monotonically_increasing_id().alias("b"), "*")
    flat = written(flat, "asked", GROUP_BLOCKS)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                yield pa.record_batch([pa.array(np.full(len(ids), r["b"])), pa.array(np.arange(len(ids))), pa.array(ids)], ["b", "i", "query_id"])

    places = flat.select("b", "ids").mapInArrow(listed, "b long, i long, query_id long")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = _Block(r["r_ids"], r["r_vectors"], r["r_strings"], dim, r["r_places"])
                q = _Block(r["ids"], r["vectors"], r["strings"], dim)
                at = np.array(r["at"])
                found: list[tuple] = []
                for level in np.unique(at[at >= 0]):
                    some = np.flatnonzero(at == level)
                    low, high = block.spans(q.codes[some], int(level))
                    for j, i in enumerate(some):
                        held = np.zeros(len(block.ids), bool)
                        for t in range(TREES if level else 1):
                            held[block.order[low[j, t] : high[j, t], t]] = True
                        dist, ids = nearest(q.ids[i], q.x[i], block.ids[held], block.x[held], k)
                        found += zip([int(q.ids[i])] * len(ids), ids.tolist(), dist.tolist())
                cells = zip(*found) if found else ((), (), ())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    def found_at(levels: DataFrame) -> DataFrame:
        """Up to ``k`` rows a block for each query of ``levels (query_id, level)``; the others (-1) are passed over."""
        placed = places.join(levels, "query_id", "left").select("b", "i", F.coalesce("level", F.lit(-1)).alias("level"))
        by_block = placed.groupBy("b").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "level"))), lambda x: x["level"]).alias("at"))  # a query block's at most
        by_block = by_block.where(F.exists("at", lambda level: level >= 0))
        met = _met(written(flat.join(by_block, "b").drop("b"), "levelled", GROUP_BLOCKS), index)
        return written(met.mapInArrow(find, "query_id long, vec_id long, score double"), "found")

    levels = written(levels, "levels-of")
    found = found_at(levels)
    # the count has repeats and the query itself: who has met fewer than k others ascends
    for _ in range(SYMBOLS):
        others = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("others"))
        short = levels.join(others, "query_id", "left").where((F.coalesce("others", F.lit(0)) < k) & (F.col("level") > 0))
        levels = written(short.select("query_id", F.floor(F.col("level") / 2).cast("int").alias("level")), "levels-of")
        if levels.isEmpty():
            break
        found = found.unionByName(found_at(levels))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _enough(truth: list, recall: float) -> int:
    """The fewest candidates (over all trees, repeats counted) at which the sampled queries find ``recall`` of their neighbours."""
    if not truth:
        return 0
    best = 2**62
    for enough in sorted({r[f"n{s}"] for r in truth for s in range(SYMBOLS + 1)}, reverse=True):
        hits = 0
        for r in truth:
            level = max([s for s in range(1, SYMBOLS + 1) if r[f"n{s}"] >= enough], default=0)
            hits += r["level"] >= level
        if hits < recall * len(truth):
            break
        best = enough
    return best
