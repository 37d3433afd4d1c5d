"""Similar texts by an exact join of their shingle sets.

A text is the set of its shingles' hashes, in one order for all texts: those
that more texts have come later. Two sets of n and m shingles with a Jaccard
similarity of t share at least t of the larger, so their prefixes, of
n - ceil(t n) + l shingles, share l of them; at some that they share, enough must
be left in both. Texts meet by the shingles of their prefixes, and every pair
that shares so many is decided by its sets: no pair of the similarity is
missed, and none below it is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import lean, scratch, small, written

#: Shingles counted at a time; of a block's, those that it has more than once are counted over all blocks.
BLOCK = 1 << 20
#: Shingles, the most frequent ones, that the order ranks; any order gives the same links.
RANKED = 200_000
#: Shingles of their prefixes that two sets must share (or t of the smaller set, if that is less).
SHARED = 12
#: Rows up to which a table of two or three numbers a row is broadcast (under 20 MB).
SLIM_ROWS = 500_000
_ADD, _MULTIPLY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; one of all words for fewer words than ``width``, none for none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    width = min(width, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = (h + w[k : n - width + 1 + k]) * _MULTIPLY + _ADD
        h ^= h >> np.uint64(29)
    return np.unique(h)


def prefix_length(n: int, similarity: float, shared: int = SHARED) -> int:
    least = math.ceil(similarity * n - 1e-9)
    return n - least + min(shared, least)



def frequent_shingles(docs: DataFrame, text_col: str, width: int, ranked: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """The ``ranked`` most frequent shingles of all ``docs``, sorted, and how many texts are known to have each.

    Counted over all texts, but in each block only shingles that stand there
    more than once, so that what is shuffled is a fraction of the input.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(s[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["s", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(shingle_set(t.as_py(), width))
                size += len(held[-1])
                if size >= BLOCK:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(lean(of), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "s").limit(ranked).toArrow()
    s, n = (top.column(c).combine_chunks().to_numpy() for c in (0, 1))
    s = s.view(np.uint64)
    by = np.argsort(s)
    return s[by], n[by]


def prefixes(docs: DataFrame, row: list[Column], text_col: str, width: int, similarity: float) -> DataFrame:
    """Columns ``row`` with (node, fp, n, mid, prefix) of each text.

    node names a shingle set, fp is its 64-bit SimHash fingerprint, n its
    size, mid how frequent its shingles are, prefix those by which it is met.
    """
    known, often = frequent_shingles(docs, text_col, width)
    rows = docs.select(*row, F.col(text_col).cast("string").alias("__text"))
    own, names = len(row), [*rows.columns[: len(row)], "node", "fp", "n", "mid", "prefix"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, size, mid, prefix = [], [], [], [], []
            for t in batch.column(own):
                s = shingle_set(t.as_py(), width)
                node.append(xxh64_intdigest(s.tobytes()))
                fp.append(_fingerprint(s))
                count = np.zeros(len(s), np.int64)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    count = np.where(known[at] == s, often[at], 0)
                size.append(len(s))
                mid.append(float(count.mean()) if len(s) else 0.0)
                # s is sorted, so a stable sort keeps equal counts in the order of hashes
                prefix.append(s[np.argsort(count, kind="stable")[: prefix_length(len(s), similarity)]].view(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()))
            cells = (np.array(node, np.uint64).view(np.int64), np.array(fp, np.uint64).view(np.int64), size, mid, prefix)
            yield pa.record_batch([*batch.columns[:own], *(pa.array(c, k) for c, k in zip(cells, kinds))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:own])
    return rows.mapInArrow(lean(of), f"{schema}, node long, fp long, n int, mid double, prefix array<long>")


def _fingerprint(s: np.ndarray) -> int:
    """SimHash of a shingle set: a bit is 1 if it is set in over half the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        votes += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(s)).view(np.uint64)[0]) if len(s) else 0


def _possible(n: Column, at: Column, m: Column, there: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles that first share one at these places can be that similar."""
    room = F.least(n - at, m - there)
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (room >= similarity / (1 + similarity) * (n + m) - 1e-9)


def met(nodes: DataFrame) -> DataFrame:
    """``(key, size, node, at, n, mid)`` for each shingle that the prefixes of several ``nodes`` hold, a row for each of these; written.

    Counted first, so that a frequent shingle is a row a task; only what is
    met is then shuffled on, and gets the rest of its columns after.
    """
    keys = nodes.select("node", F.posexplode("prefix").alias("at", "key"))
    with scratch() as keep:
        held = written(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "keys")
        several = written(keys.join(held.hint("merge"), "key"), "several")
        return keep(written(several.join(nodes.select("node", "n", "mid"), "node").select("key", "size", "node", "at", "n", "mid"), "met"))


def heads(seen: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: each text with that which most often has the most frequent shingles of those under a shingle of its prefix; of a group of copies, mostly what they are copies of.

    Pairs that meet far less often than similar ones do are left out here: they
    have another chance in ``across``, which leaves out none.
    """
    first = written(seen.groupBy("key").agg(F.max(F.struct("mid", "node", "n")).alias("head")), "heads")
    c = F.col
    alike = F.least("n", "head.n") >= similarity * F.greatest("n", "head.n") - 1e-9
    pairs = seen.select("key", "node", "n").join(small(first, first.count()), "key").where((c("head.node") != c("node")) & alike)
    often = pairs.groupBy(c("node").alias("a"), c("head.node").alias("b")).agg(F.count("*").alias("times"), F.min(F.least("n", "head.n")).alias("n"))
    best = often.where(3 * c("times") >= _needed("n", similarity)).groupBy("a").agg(F.max(F.struct("times", "b")).alias("best"))
    return best.select("a", c("best.b").alias("b"))


def _needed(n: Column | str, similarity: float) -> Column:
    """Shingles of their prefixes that two sets share if they are similar, the smaller of ``n`` shingles."""
    return F.least(F.lit(SHARED), F.ceil(similarity * (F.col(n) if isinstance(n, str) else n) - 1e-9))


def across(seen: DataFrame, nodes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of all texts of different ``groups (node, root)`` that share shingles enough in their prefixes, however large the buckets.

    They meet at the first shingle that they share, where enough is left in
    both; what meets is then counted by its whole prefixes.
    """
    c = F.col
    rest = seen.select("key", "node", "n", "at").join(groups, "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("g"))
    both = (c("x.key") == c("y.key")) & (c("x.node") > c("y.node")) & (c("x.g") != c("y.g")) & _possible(c("x.n"), c("x.at"), c("y.n"), c("y.at"), similarity)
    pairs = written(rest.alias("x").join(rest.alias("y"), both).select(c("x.node").alias("a"), c("y.node").alias("b")).distinct(), "open")
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(c("node").alias(end), c("n").alias(f"n{end}"), c("prefix").alias(f"p{end}")), end)
    return pairs.where(F.size(F.array_intersect("pa", "pb")) >= _needed(F.least("na", "nb"), similarity)).select("a", "b")


def sets(docs: DataFrame, names: DataFrame, row: dict[str, Column], text_col: str, width: int) -> DataFrame:
    """``(node, s)``: the shingle sets of ``names (node, *row, __times)``, each from a row of ``docs`` with these values, of which there are so many; written."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                held = [shingle_set(t.as_py(), width).tobytes() for t in some.column(1)]
                yield pa.record_batch([some.column(0), pa.array(held, pa.binary())], ["node", "s"])

    texts = docs.select(*(c.alias(k) for k, c in row.items()), F.col(text_col).cast("string").alias("__text"))
    found = texts.join(small(names, names.count(), SLIM_ROWS), list(row)).select("node", "__text", "__times")
    once = found.where("__times = 1").drop("__times")
    if not names.where("__times > 1").isEmpty():  # rows equal in all columns
        once = once.unionByName(found.where("__times > 1").drop("__times").dropDuplicates(["node"]))
    return written(once.mapInArrow(lean(of), "node long, s binary"), "sets")


def decided(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, row: dict[str, Column], text_col: str, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs (a, b)`` whose shingle sets are that similar; written. ``nodes (node, *row, __times)`` names a row of ``docs`` for each."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(n >= similarity * (len(x) + len(y) - n) - 1e-9)
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with scratch() as keep:
        pairs = written(pairs.distinct(), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        names = written(nodes.select("node", *row, "__times").join(ends, "node", "left_semi"), "names")
        held = sets(docs, names, row, text_col, width)
        both = pairs
        for end in ("b", "a"):  # only the sets that a side needs are shuffled
            one = written(pairs.select(F.col(end).alias("node")).distinct(), "ends")
            needed = held.join(small(one, one.count(), SLIM_ROWS), "node", "left_semi")
            both = both.join(needed.select(F.col("node").alias(end), F.col("s").alias(f"s{end}")), end)
        return keep(written(both.select("a", "b", "sa", "sb").mapInArrow(lean(judge), "a long, b long"), "alike"))
