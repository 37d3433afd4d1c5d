"""What the operators of this subpackage share: tables, words, written stages."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (Java and RE2 alike).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table of one short row per key is broadcast (about 10 MB).
BROADCAST_ROWS = 50_000

#: Tables not yet deleted: those of the session at first, of each open ``scratch`` after.
_written: list[list[tuple[SparkSession, str]]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="indexloom-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so a lost executor costs only a reread.

    ``group_rows``: rows of a row group at most, for tables of rows of many
    MB, which the writer would else gather by the hundred before it looks at
    their size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/indexloom-{uuid.uuid4().hex}-{label}"
    (df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    _written[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        with contextlib.suppress(Exception):  # the session may be gone
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the yielded function was given.

    What leaves the block must rest on these alone; as each is a finished
    table, nothing deleted is needed again, executors lost or not.
    """
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._written_path)
        return df

    _written.append([])
    try:
        yield keep
    finally:
        mine = _written.pop()
        _written[-1] += [t for t in mine if t[1] in kept]
        _delete([t for t in mine if t[1] not in kept])


def drop_written() -> None:
    """Delete the tables that ``written`` has left; runs at exit too."""
    for held in _written:
        _delete(held)
        held.clear()


atexit.register(drop_written)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; else a shuffled join follows, whose skew AQE splits."""
    return F.broadcast(df) if rows <= most else df


def give_back() -> None:
    """Return to the system what this process has freed but holds: a Python worker outlives its task and stays beside its executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f``, for ``mapInArrow`` and the like, with ``give_back`` before each batch but the first and at the end."""

    def of(batches: Iterator) -> Iterator:
        def each() -> Iterator:
            for k, batch in enumerate(batches):
                if k:
                    give_back()
                yield batch
                del batch

        yield from f(each())
        give_back()

    return of


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
