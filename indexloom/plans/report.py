"""Report tables and the bundle they are published in."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, reviews
from ..operators.reviews import REVIEW

#: Rows of a sheet of a spreadsheet file.
SHEET_ROWS = 1_048_576


def schedule(constituents: DataFrame, index_id: str = "index") -> DataFrame:
    """Each review with its reference date and how many names it holds."""
    return constituents.groupBy(REVIEW, "reference_date").agg(F.count("*").alias("instrument_count")).withColumn("index_id", F.lit(index_id))


def latest_holdings(constituents: DataFrame) -> DataFrame:
    """The last review's names with weights."""
    last = F.broadcast(constituents.agg(F.max(REVIEW).alias("__d")))
    d = constituents.join(last, F.col(REVIEW) == F.col("__d")).drop("__d")
    return d.where("index_weight > 0").select(REVIEW, "instrument_id", "country", "industry", "index_weight", "benchmark_weight", (F.col("index_weight") - F.col("benchmark_weight")).alias("active_weight"))


def exposures(constituents: DataFrame) -> DataFrame:
    """Country and industry exposures in one long table."""
    parts = [reviews.exposures(constituents, c).select(REVIEW, F.lit(c).alias("classification"), F.col(c).alias("group"), "portfolio_weight", "benchmark_weight", "active_weight") for c in ("country", "industry")]
    return parts[0].unionByName(parts[1])


def performance(daily: DataFrame) -> DataFrame:
    """Daily returns with active returns where they are not given."""
    for k in ("price", "gross_total", "net_total"):
        i, b, a = f"index_{k}_return", f"benchmark_{k}_return", f"active_{k}_return"
        if i in daily.columns and b in daily.columns and a not in daily.columns:
            daily = daily.withColumn(a, F.col(i) - F.col(b))
    return daily


def turnover(rebalances: DataFrame) -> DataFrame:
    """One-way and two-way turnover of each rebalance; two-way is twice one-way where it is not given."""
    return rebalances.select("scheduled_effective_date", "applied_date", F.col("index_turnover").alias("one_way_turnover"), (2 * F.col("index_turnover")).alias("two_way_turnover"), F.col("benchmark_turnover").alias("benchmark_one_way_turnover"))


def attribution(detail: DataFrame, period: str = "period", group: str = "industry") -> DataFrame:
    """Attribution in long form: ``(period, group, component, value)``."""
    parts = F.array(*[F.struct(F.lit(f"brinson.{c}").alias("component"), F.col(c).alias("value")) for c in ("allocation", "selection", "interaction", "total_attribution")])
    return detail.select(period, F.col(group).alias("group"), F.explode(parts).alias("p")).select(period, "group", "p.*")


def validation(constituents: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Whether each review's weights sum to 1 and none is negative."""
    v = reviews.validation(constituents, tolerance)
    ok = (F.abs(F.col("portfolio_weight_sum") - 1) <= tolerance) & (F.col("minimum_portfolio_weight") >= -tolerance)
    return v.select(REVIEW, F.lit("weights").alias("check"), F.when(ok, "passed").otherwise("failed").alias("status"), F.col("portfolio_weight_sum").alias("value"))


def overview(constituents: DataFrame, index_id: str = "index") -> DataFrame:
    """``(field, value)`` rows of what an index is: its reviews, names and latest holdings."""
    last = F.max(REVIEW)
    row = constituents.groupBy(REVIEW).agg(F.count_if(F.col("index_weight") > 0).alias("held"))
    names = constituents.agg(F.count_distinct("instrument_id").alias("names"))
    row = row.agg(F.min(REVIEW).alias("first"), last.alias("last"), F.count("*").alias("reviews"), F.max_by("held", REVIEW).alias("held")).join(names)
    cells = (("index", F.lit(index_id)), ("first_review", F.col("first")), ("last_review", F.col("last")), ("reviews", F.col("reviews")), ("instruments", F.col("names")), ("latest_holdings", F.col("held")))
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c.cast("string").alias("value")) for k, c in cells])).alias("p")).select("p.*")


def data_sources(spark: SparkSession, provenance: Any) -> DataFrame:
    """``(provider, capability, requests)`` of what a run asked for."""
    rows = [(c["provider"], c["capability"]) for c in provenance.calls]
    return spark.createDataFrame(rows, "provider string, capability string").groupBy("provider", "capability").agg(F.count("*").alias("requests"))


def flattened(values: Mapping[str, Any], at: str = "") -> list[dict]:
    """Nested parameters as ``parameter, value`` rows, sensitive ones left out."""
    out = []
    for k, v in values.items():
        name = f"{at}.{k}" if at else str(k)
        if any(x in str(k).lower() for x in ("password", "secret", "token", "api_key", "connection")):
            continue
        out += flattened(v, name) if isinstance(v, Mapping) else [{"parameter": name, "value": json.dumps(v, default=str)}]
    return out


def chunked(df: DataFrame, order: list[str], rows: int = SHEET_ROWS - 1) -> DataFrame:
    """``df`` with the number of the sheet each row goes to, in order; for tables that a person opens."""
    from pyspark.sql import Window

    return df.withColumn("sheet", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / rows).cast("int"))


def text_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the rest as it is."""
    return df.select(*[F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes])


def write_bundle(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], summary: Mapping[str, Any] | None = None, overwrite: bool = False) -> dict:
    """Redacted Parquet tables and a JSON manifest under ``path``: written beside, then moved there whole.

    A bundle that is there stays, unless ``overwrite``. The manifest names
    each table's rows and content digest, which do not depend on wall time.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm_path(path)) and not overwrite:
        raise FileExistsError(path)
    tmp = f"{path.rstrip('/')}.staged"
    fs.delete(jvm_path(tmp), True)
    manifest: dict = {"summary": dict(summary or {}), "tables": {}}
    for name, df in sorted(tables.items()):
        quality.redact(text_columns(df)).write.option("compression", "zstd").parquet(f"{tmp}/tables/{name}")
        back = spark.read.parquet(f"{tmp}/tables/{name}")
        manifest["tables"][name] = {"rows": back.count(), "columns": back.columns, "content": quality.content_digest(back)}
    line = json.dumps(manifest, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{tmp}/manifest")
    if overwrite:
        fs.delete(jvm_path(path), True)
    if not fs.rename(jvm_path(tmp), jvm_path(path)):
        raise OSError(f"{tmp} could not be moved to {path}")
    return manifest


def dashboard(tables: Mapping[str, DataFrame], title: str = "Index risk", rows: int = 200) -> str:
    """Small tables as one HTML page; each shows its first rows, as a page for people does."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}" for v in r) for r in df.limit(rows).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}{body}</table>")
    return "\n".join(parts)
