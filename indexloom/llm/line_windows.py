"""Line dedup over overlapping windows of consecutive lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import lean, scratch, written

LINES = 3
#: Windows emitted at a time; bounds what a text of very many lines adds to a batch.
BLOCK = 1 << 15


def window_hashes(text: str | None, lines: int = LINES) -> Iterator[tuple[int, np.ndarray]]:
    """``(position, hashes)`` by blocks: 128 bits as two longs for each window of ``lines`` consecutive lines, in order; none for fewer lines."""
    if not text or text.count("\n") < lines - 1:
        return
    each = [xxh3_128_digest(line) for line in text.encode("utf-8", "surrogatepass").split(b"\n")]
    n = len(each) - lines + 1
    for at in range(0, n, BLOCK):
        held = b"".join(each[at : at + BLOCK + lines - 1])
        found = b"".join([xxh3_128_digest(held[16 * k : 16 * (k + lines)]) for k in range(min(BLOCK, n - at))])
        yield at, np.frombuffer(found, "<i8").reshape(-1, 2)


def windows(docs: DataFrame, id_col: str, text_col: str, lines: int) -> DataFrame:
    """``(id, th, pos, h1, h2)`` for each window of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "th", "pos", "h1", "h2"]
        for batch in batches:
            row, pos, found, size = [], [], [], 0

            def block() -> pa.RecordBatch:
                h, at = np.concatenate(found), pa.array(np.concatenate(row))
                cells = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(pos)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
                return pa.record_batch(cells, names)

            for k, text in enumerate(batch.column(2)):
                for at, h in window_hashes(text.as_py(), lines):
                    row.append(np.full(len(h), k))
                    pos.append(np.arange(at, at + len(h), dtype=np.int32))
                    found.append(h)
                    size += len(h)
                    if size >= BLOCK:
                        yield block()
                        row, pos, found, size = [], [], [], 0
            if size:
                yield block()

    return rows.mapInArrow(lean(of), f"id {rows.schema['id'].dataType.simpleString()}, th long, pos int, h1 long, h2 long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with ``kept_text`` and ``removed``, the ascending positions (from 0) of the lines taken out of each text.

    Every window of ``lines`` consecutive lines (split at line feeds) is hashed;
    a window seen before, in order of id (null first), then text hash, then
    position, is a later occurrence, and all lines it covers go, also such
    as a first occurrence covers too: of a line repeated four times in a row
    one stays. Overlapping later occurrences merge. Texts of fewer lines
    have no window and stay whole; a null text stays null, removed empty. Rows
    equal in id and text are one document: they fare alike and are not
    repeats of each other. Other columns stay; an empty table gives none.
    """
    with scratch() as keep:
        seen = written(windows(docs, id_col, text_col, lines), "windows")
        place = F.struct("id", "th", "pos")
        first = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
        first = written(first, "repeated")  # so that the join meets two plain shuffles, whose hot windows AQE can split
        later = seen.join(first.hint("merge"), ["h1", "h2"]).where(place != F.col("first"))
        covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + (lines - 1)))))
        gone = later.groupBy("id", "th").agg(F.sort_array(covered).alias("removed")).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "removed")
        gone = keep(written(gone, "gone"))
    # both joins are shuffled at any size, and so behave alike at all
    out = docs.drop("removed", "kept_text").join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left")
    # two steps: the lines are split once, and each stays found by its position
    split = F.when(F.col("removed").isNotNull(), F.split(text_col, "\n", -1))
    out = out.withColumn("__lines", split)
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "removed")
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    out = out.withColumn("kept_text", F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(kept))
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>"))).drop("__id", "__th", "__lines")
