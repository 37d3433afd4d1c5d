"""A catalogue of research runs: definitions, their tables and what can be read back from them."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recipes import digest
from .store import Reference, Store

STAGE = "research_run"


@dataclass(frozen=True)
class Run:
    """A finished run: its id, its definition and its tables, read lazily."""

    run_id: str
    definition: Mapping[str, Any]
    tables: Mapping[str, DataFrame] = field(repr=False)


class Runs:
    """Runs in a store: each is a manifest of bindings under its id."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def record(self, definition: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> str:
        """Store a run's tables; the same definition may run again and is then another run."""
        run_id = digest([dict(definition), time.time_ns()])[:16]
        note = json.dumps({"definition": dict(definition), "fingerprint": digest(dict(definition))}, sort_keys=True, default=str)
        for name, df in tables.items():
            self.store.bind(STAGE, run_id, name, self.store.save(df), note)
        return run_id

    def manifests(self, include_invalidated: bool = False) -> DataFrame:
        """``(run_id, fingerprint, created, tables, rows, status)``, a row a run."""
        held = self.store.catalog().where(F.col("stage") == STAGE)
        held = held if include_invalidated else held.where("status <> 'invalidated'")
        return held.groupBy(F.col("cache_key").alias("run_id")).agg(
            F.get_json_object(F.max("note"), "$.fingerprint").alias("fingerprint"), F.max("created").alias("created"),
            F.sort_array(F.collect_set("name")).alias("tables"), F.sum("rows").alias("rows"), F.max("status").alias("status"),
        )

    def latest(self, definition: Mapping[str, Any] | None = None, include_invalidated: bool = False) -> str | None:
        """The newest run, or the newest of one definition."""
        runs = self.manifests(include_invalidated)
        runs = runs if definition is None else runs.where(F.col("fingerprint") == digest(dict(definition)))
        row = runs.orderBy(F.desc("created")).first()
        return row["run_id"] if row else None

    def rehydrate(self, run_id: str) -> Run:
        """A run's tables from where they are stored."""
        rows = self.store.catalog().where((F.col("stage") == STAGE) & (F.col("cache_key") == run_id)).collect()  # a row a table
        if not rows:
            raise LookupError(f"no run {run_id}")
        tables = {r["name"]: self.store.load(Reference(r["content"], r["rows"], r["path"]), verify=False) for r in rows}
        return Run(run_id, json.loads(rows[0]["note"])["definition"], tables)

    def coverage(self, include_invalidated: bool = False) -> DataFrame:
        """``(fingerprint, runs, table, runs_with_table, rows)``: which tables the runs of each definition have."""
        held = self.store.catalog().where(F.col("stage") == STAGE)
        held = held if include_invalidated else held.where("status <> 'invalidated'")
        held = held.withColumn("fingerprint", F.get_json_object("note", "$.fingerprint"))
        runs = held.groupBy("fingerprint").agg(F.count_distinct("cache_key").alias("runs"))
        by = held.groupBy("fingerprint", F.col("name").alias("table")).agg(F.count_distinct("cache_key").alias("runs_with_table"), F.sum("rows").alias("rows"))
        return by.join(runs, "fingerprint").select("fingerprint", "runs", "table", "runs_with_table", "rows")


def summary(run: Run) -> DataFrame:
    """``(run_id, table, rows, columns)`` of a run's tables."""
    spark = next(iter(run.tables.values())).sparkSession
    rows = [(run.run_id, name, df.count(), len(df.columns)) for name, df in sorted(run.tables.items())]
    return spark.createDataFrame(rows, "run_id string, table string, rows long, columns int")
