"""A store of immutable tables with a catalog: content-addressed Parquet, bound to cache keys.

Tables and catalog go through Spark, so any file system that Spark reads will
do. A table is written beside, checked by digest and then named by it. The
catalog is a log: each change appends its rows, and the last row of a binding
counts, so writers never wait for or overwrite each other. Each binding is
also written beside its table, from where the log can be made again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import content_digest
from .recipes import digest


class Mode(StrEnum):
    OFF = "off"
    REUSE = "reuse"
    REFRESH = "refresh"
    READ_ONLY = "read_only"


class Damaged(ValueError):
    """Stored rows are not what was stored."""


_CATALOG = "stage string, cache_key string, name string, content long, rows long, path string, status string, created double, note string"
_LOG = _CATALOG + ", changed double, event string"
_KEY = ("stage", "cache_key", "name")
_STATUSES = ("draft", "reviewed", "approved", "superseded", "invalidated")


@dataclass(frozen=True)
class Reference:
    content: int
    rows: int
    path: str


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- tables --

    def save(self, df: DataFrame, sort_by: Sequence[str] = ()) -> Reference:
        """Write ``df`` once; equal rows are one object whoever stores them."""
        tmp = f"{self.root}/tmp/{uuid.uuid4().hex}"
        out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
        out.write.option("compression", "zstd").parquet(tmp)
        back = self.spark.read.schema(df.schema).parquet(tmp)
        content, rows = content_digest(back), back.count()
        path = f"{self.root}/objects/{digest([content, rows, df.schema.json()])}"
        if self._fs.exists(self._path(path)):
            self._fs.delete(self._path(tmp), True)
        else:
            self._fs.mkdirs(self._path(f"{self.root}/objects"))
            if not self._fs.rename(self._path(tmp), self._path(path)):
                raise OSError(f"{tmp} could not be moved to {path}")
        return Reference(content, rows, path)

    def load(self, reference: Reference, verify: bool = True) -> DataFrame:
        df = self.spark.read.parquet(reference.path)
        if verify and content_digest(df) != reference.content:
            raise Damaged(reference.path)
        return df

    # -- catalog --

    def catalog(self) -> DataFrame:
        """The bindings as their last changes left them."""
        last = self._log().groupBy(*_KEY).agg(F.max_by(F.struct("content", "rows", "path", "status", "created", "note"), F.struct("changed", "event")).alias("b"))
        return last.select(*_KEY, "b.*")

    def _log(self) -> DataFrame:
        if not self._fs.exists(self._path(f"{self.root}/catalog/_SUCCESS")):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/catalog")

    def _append(self, df: DataFrame) -> None:
        """One more file of the log with these bindings as they are now."""
        event = F.lit(f"{time.time():.6f}-{uuid.uuid4().hex}")
        df.select(*_KEY, "content", "rows", "path", "status", "created", "note", F.lit(time.time()).alias("changed"), event.alias("event")).coalesce(1).write.mode("append").parquet(f"{self.root}/catalog")

    def bind(self, stage: str, key: str, name: str, reference: Reference, note: str = "") -> None:
        self.bind_all([(stage, key, name)], reference, note)

    def bind_all(self, bindings: Sequence[tuple[str, str, str]], reference: Reference, note: str = "") -> None:
        """Several ``(stage, key, name)`` bound to one object, as one change."""
        now = time.time()
        row = self.spark.createDataFrame([(*b, reference.content, reference.rows, reference.path, "draft", now, note) for b in bindings], _CATALOG)
        row.coalesce(1).write.mode("append").json(f"{reference.path}/_bindings")
        self._append(row)

    def rebuild_catalog(self) -> int:
        """The log made again from the bindings beside the tables, all as drafts; the number of these."""
        self._fs.delete(self._path(f"{self.root}/catalog"), True)
        paths = [f"{p}/_bindings" for p in self._objects() if self._fs.exists(self._path(f"{p}/_bindings"))]
        if not paths:
            return 0
        rows = self.spark.read.schema(_CATALOG).json(paths).groupBy(*_KEY).agg(F.max_by(F.struct("content", "rows", "path", "status", "created", "note"), "created").alias("b"))
        self._append(rows.select(*_KEY, "b.*"))
        return self.catalog().count()

    def resolve(self, stage: str, key: str, name: str) -> Reference | None:
        row = self.catalog().where((F.col("stage") == stage) & (F.col("cache_key") == key) & (F.col("name") == name) & (F.col("status") != "invalidated")).first()
        return Reference(row["content"], row["rows"], row["path"]) if row else None

    def _change(self, hit, status: str) -> None:
        self._append(self.catalog().where(hit).withColumn("status", F.lit(status)))

    def set_status(self, stage: str, key: str, status: str, name: str | None = None) -> None:
        if status not in _STATUSES:
            raise ValueError(f"unknown status {status}")
        self._change((F.col("stage") == stage) & (F.col("cache_key") == key) & (F.lit(True) if name is None else F.col("name") == name), status)

    def invalidate(self, stage: str, key: str | None = None, name: str | None = None) -> None:
        hit = F.col("stage") == stage
        hit = hit if key is None else hit & (F.col("cache_key") == key)
        self._change(hit if name is None else hit & (F.col("name") == name), "invalidated")

    def latest(self, stage: str) -> dict | None:
        """The newest valid binding of a stage."""
        row = self.catalog().where((F.col("stage") == stage) & (F.col("status") != "invalidated")).orderBy(F.desc("created")).first()
        return row.asDict() if row else None

    def verify(self) -> list[str]:
        """Paths of bound tables that are gone or changed."""
        bad = []
        for r in self.catalog().select("path", "content").distinct().collect():
            if not self._fs.exists(self._path(r["path"])) or content_digest(self.spark.read.parquet(r["path"])) != r["content"]:
                bad.append(r["path"])
        return bad

    def _objects(self, older_than: float = 0.0) -> list[str]:
        top = self._path(f"{self.root}/objects")
        last = (time.time() - older_than) * 1000
        return [f"{self.root}/objects/{s.getPath().getName()}" for s in self._fs.listStatus(top) if s.getModificationTime() <= last] if self._fs.exists(top) else []

    def prune(self, dry_run: bool = True, older_than: float = 86_400.0) -> list[str]:
        """Objects that no valid binding names and that are older than so many seconds (younger ones a writer may be about to bind); deleted unless it is a dry run."""
        used = {r["path"] for r in self.catalog().where("status <> 'invalidated'").select("path").distinct().collect()}
        gone = sorted(set(self._objects(older_than)) - used)
        for p in [] if dry_run else gone:
            self._fs.delete(self._path(p), True)
        return gone

    # -- caching --

    def cached(self, stage: str, identity: Any, name: str, make, mode: Mode = Mode.REUSE) -> DataFrame:
        """``make()``, or what is stored for the same identity.

        OFF: always made, never stored. REUSE: stored if there, else made and
        stored. REFRESH: made and stored anew. READ_ONLY: stored, or an error.
        """
        if mode == Mode.OFF:
            return make()
        key = digest(identity)
        found = None if mode == Mode.REFRESH else self.resolve(stage, key, name)
        if found is None:
            if mode == Mode.READ_ONLY:
                raise LookupError(f"{stage}/{name} is not stored")
            found = self.save(make())
            self.bind(stage, key, name, found)
        return self.load(found, verify=False)


def covering(ranges: Sequence[tuple[str, str]], start: str, end: str) -> list[tuple[str, str]] | None:
    """The fewest stored date ranges that cover a range, first to last; None if some day lies in none."""
    import datetime as dt

    day = dt.timedelta(days=1)
    held = sorted((dt.date.fromisoformat(a), dt.date.fromisoformat(z)) for a, z in ranges)
    at, last, out = dt.date.fromisoformat(start), dt.date.fromisoformat(end), []
    while at <= last:
        fits = [r for r in held if r[0] <= at <= r[1]]
        if not fits:
            return None
        best = max(fits, key=lambda r: (r[1], -(r[0].toordinal())))
        out.append((best[0].isoformat(), best[1].isoformat()))
        at = best[1] + day
    return out


def missing_segments(wanted: DataFrame, stored: DataFrame, keys: Sequence[str] = ("segment_key",)) -> DataFrame:
    """Segments that have to be computed: those wanted and not stored."""
    return wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def segment_key(configuration: Mapping[str, Any], targets: int, opening: int | None) -> str:
    """Identity of a holding segment: what is configured, what is held and the state it opens with."""
    return digest([dict(configuration), targets, opening])


_temporary: list[Store] = []


def temporary(spark: SparkSession) -> Store:
    """A store of its own in the session's shared checkpoint folder, deleted at exit; a machine-local one only in local mode."""
    import atexit
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="indexloom-")
    if not _temporary:
        atexit.register(_drop_temporary)
    _temporary.append(Store(spark, f"{root.rstrip('/')}/indexloom-store-{uuid.uuid4().hex}"))
    return _temporary[-1]


def _drop_temporary() -> None:
    import contextlib

    for s in _temporary:
        with contextlib.suppress(Exception):  # the session may be gone
            s._fs.delete(s._path(s.root), True)
