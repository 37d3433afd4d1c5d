"""SimHash near-duplicate groups by pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints
differ in at most ``distance`` (up to 3) bits, some start on the ring has
chains of 1, 2, 3 and 4 consecutive segments whose differences sum to at most
1, 2, 3 and 4 quarters of it. With 3 that means: first segment equal, first
two differ in at most 1 bit, first three in at most 2. So either both first
segments are equal, or one half of the second and one half of the third are:
five 32-bit keys for each start, twenty in all, joined by equality. The chain
budgets then prune what meets under a key before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, small, written
from .components import components
from .simhash_kernel import fingerprint

SEGMENTS, BITS = 4, 16
#: Distinct fingerprints under one key beyond which they are linked by way of hubs, not pair by pair.
PAIRED = 512


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; null and wordless texts have fp 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((fingerprint(t.as_py(), width) for t in batch.column(1)), pa.int64())
            yield pa.record_batch([batch.column(0), fps], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(of), "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * (i % SEGMENTS)).bitwiseAND(0xFFFF)


def _keys(fp: Column) -> Column:
    """The twenty keys, each a long: table number above 32 bits of the fingerprint."""
    keys = []
    for i in range(SEGMENTS):
        a, b, c = (_segment(fp, i + k) for k in range(3))
        parts = [F.shiftleft(a, 16).bitwiseOR(b)]
        for j in (0, 8):
            for k in (0, 8):
                half_b, half_c = (F.shiftrightunsigned(x, at).bitwiseAND(0xFF) for x, at in ((b, j), (c, k)))
                parts.append(F.shiftleft(a, 16).bitwiseOR(F.shiftleft(half_b, 8)).bitwiseOR(half_c))
        keys += [p.bitwiseOR(F.lit((5 * i + n) << 32)) for n, p in enumerate(parts)]
    return F.array(*keys)


def _chained(a: Column, b: Column, distance: int) -> Column:
    """Some start has chains within their proportional budgets, the last of which is the full Hamming check."""
    diff = [F.bit_count(_segment(a.bitwiseXOR(b), i)) for i in range(SEGMENTS)]
    starts = F.lit(False)
    for i in range(SEGMENTS):
        chain, ok = F.lit(0), F.lit(True)
        for n in range(1, SEGMENTS + 1):
            chain = chain + diff[(i + n - 1) % SEGMENTS]
            ok = ok & (chain <= n * distance // SEGMENTS)
        starts = starts | ok
    return starts


def _hub_links(hot: DataFrame, distance: int) -> DataFrame:
    """Links of the same components as all pairs of ``hot (fp)`` within ``distance`` would give, in rows linear in its size.

    Of two fingerprints 3 bits apart, one is at most 1 bit and the other at
    most 2 from some word between them. All that are near such a hub hold
    together if one of them is within 1 bit: that one is within 3 of each.
    """
    near, i, j = distance // 2, F.col("i"), F.col("j")
    # i, j: the bits to flip, 64 for none; 2,081 hubs each at most
    flips = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    flips = flips.select("fp", "i", F.explode(F.sequence(F.lit(0), i)).alias("j")).where((i != j) | (i == 64))
    mask = [F.when(x < 64, F.call_function("shiftleft", F.lit(1).cast("long"), x)).otherwise(F.lit(0).cast("long")) for x in (i, j)]
    around = flips.select(F.col("fp").bitwiseXOR(mask[0]).bitwiseXOR(mask[1]).alias("hub"), "fp", ((i < 64).cast("int") + (j < 64).cast("int")).alias("d"))
    around = around.where(F.col("d") <= distance - near)
    held = around.groupBy("hub").agg(F.min("fp").alias("b"), F.min("d").alias("d"), F.count("*").alias("n"))
    held = held.where((F.col("n") > 1) & (F.col("d") <= near)).select("hub", "b")
    return around.join(held, "hub").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, distance: int = 3, paired: int = PAIRED) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of distinct ``fps (fp)`` within ``distance`` bits.

    Keys with up to ``paired`` fingerprints are joined pair by pair, all of
    them; the rest goes by way of hubs, so no group is ever expanded into all
    its pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance is 0 to 3")
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    held = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    met = written(keyed.join(small(held, held.count()), "key"), "met")
    cold = met.where(F.col("n") <= paired).select("key", "fp")
    a, b = cold.alias("a"), cold.alias("b")
    near = _chained(F.col("a.fp"), F.col("b.fp"), distance)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp")) & near)
    out = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()
    hot = met.where(F.col("n") > paired).select("fp").distinct()
    if not hot.isEmpty():
        out = out.union(_hub_links(hot, distance))
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, paired: int = PAIRED) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints that
    differ in at most ``distance`` bits. Equal texts share a fingerprint, so
    groups of copies cost one row each. Null ids count for no component's
    smallest (null if a component has no other); null, empty and wordless
    texts have fingerprint 0 and are linked like any other; repeated rows each
    come back; other columns are not read; an empty table gives none.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "fps")
    return rows.join(_named(rows, distance, paired), "fp").select("doc_id", "fp", "component_id")


def _named(rows: DataFrame, distance: int, paired: int) -> DataFrame:
    """``(fp, component_id)``, a row each; written, so that what joins it by fp meets two plain shuffles and AQE can split hot ones."""
    with scratch() as keep:
        first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        roots = components(links(first.select("fp"), distance, paired)).withColumnRenamed("node", "fp")
        least = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("least"))
        of_linked = roots.join(least, "root").select("fp", "least")
        return keep(written(first.join(of_linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named"))
