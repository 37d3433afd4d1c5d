"""One document of each group of near-duplicates: SimHash with pigeonring filtering, completed by an exact join.

Fingerprints within 3 of 64 bits, found by the chains of ``simhash``, are near
copies, but texts whose shingles are similar by 0.8 differ in some ten bits, a
distance at which the chains no longer filter. So these links, each checked by
the texts' shingle sets, only make groups early; what they leave apart is
compared by ``shingle_join``, which misses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_join, simhash
from .common import scratch, small, written
from .components import components

WIDTH, SIMILARITY, DISTANCE = 5, 0.8, 3


def near_fingerprints(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes (node, fp)`` that join all whose fingerprints are within ``distance`` bits of each other."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    same = nodes.join(first, "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = simhash.links(first.select("fp"), distance)
    ends = first.select(F.col("fp").alias("a"), F.col("first").alias("na")), first.select(F.col("fp").alias("b"), F.col("first").alias("nb"))
    return same.unionByName(links.join(ends[0], "a").join(ends[1], "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))


def linked(nodes: DataFrame, docs: DataFrame, row: dict[str, Column], text_col: str, width: int, similarity: float) -> DataFrame:
    """``(node, root)`` of those ``nodes (node, *row, __times, fp, n, mid, prefix)`` that are linked to others.

    First each text meets those of a near fingerprint, and one that has the
    most frequent shingles of those it shares shingles with. What that links
    is one, and last all texts of other groups that share enough of its prefix
    are met.
    """
    how = (docs, nodes, row, text_col, width, similarity)
    with scratch() as keep:
        near = written(near_fingerprints(nodes.select("node", "fp")), "near")
        seen = shingle_join.met(nodes)
        first = shingle_join.decided(near.unionByName(shingle_join.heads(seen, similarity)), *how)
        rest = shingle_join.decided(shingle_join.across(seen, nodes, components(first), similarity), *how)
        keep(first)
        keep(rest)
    return components(first.unionByName(rest))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of texts whose ``width``-word shingles are that similar.

    The first row of a group stays, by id (null last), then text hash, then a hash of
    the whole row, whatever ids repeat: texts of different groups all keep a
    row. Wordless texts, null ones too, are one group. Reruns give the same
    rows. An empty table gives none; all columns are kept.
    """
    whole = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in docs.dtypes]
    row = {"__id": F.col(id_col).cast("long"), "__th": F.xxhash64(F.col(text_col).cast("string")), "__rh": F.xxhash64(*whole)}
    with scratch() as keep:
        with scratch() as keep_nodes:
            rows = written(shingle_join.prefixes(docs, [c.alias(k) for k, c in row.items()], text_col, width, similarity), "prefixes")
            times = written(rows.groupBy(*row).agg(F.count("*").alias("__times"), F.min("node").alias("node")), "times")
            names = times.groupBy("node").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), *row, "__times")).alias("name"))
            cells = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "mid", "prefix")))
            nodes = keep_nodes(written(cells.join(names, "node").select("node", "name", "name.*", "fp", "n", "mid", "prefix"), "nodes"))
        by_hash = {k: row[k] for k in ("__th", "__rh")}
        roots = linked(nodes, docs, by_hash, text_col, width, similarity)
        of_each = nodes.select("node", "name").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("name").alias("name"))
        kept = keep(written(of_each.select(*(f"name.{k}" for k in (*row, "__times"))), "kept"))
        few = small(kept, kept.count(), shingle_join.SLIM_ROWS)
        several = not kept.where("__times > 1").isEmpty()
    at = docs.withColumns({f"{k}_": c for k, c in row.items()})
    same = F.col("__id").eqNullSafe(F.col("__id_")) & (F.col("__th") == F.col("__th_")) & (F.col("__rh") == F.col("__rh_"))
    found = at.join(few, same)
    once = found.where("__times = 1")
    if several:  # rows equal in all columns: any of them
        once = once.unionByName(found.where("__times > 1").dropDuplicates(["__th", "__rh"]))
    return once.select(docs.columns)
