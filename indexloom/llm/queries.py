"""The queries of this subpackage, each an operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tools, html_consensus, license_join, line_windows, mixing, packing, prefix_forest, quality_mil, rule_cascade, simhash
from .common import table
from .oracles import ORACLES

#: JSON schemas of the tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_consensus.extract(table(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, the first of them, and the length and md5 of the text that stays."""
    out = line_windows.dedup_lines(table(spark, sf_dir, "documents"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    removed = F.size("removed")
    return out.select(
        "doc_id", lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.get("removed", F.lit(0)).cast("long").alias("first_removed"),
        F.length("kept_text").cast("long").alias("kept_chars"), F.md5("kept_text").alias("kept_md5"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: its canonical JSON, counts of messages and calls, and the JSON's length and md5."""
    out = chat_tools.linked(table(spark, sf_dir, "conversations"), TOOLS)
    return out.select("conv_id", "json", "n_messages", "n_calls", "n_linked", "n_orphans", "n_invalid", F.length("json").cast("long").alias("json_chars"), F.md5("json").alias("json_md5"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_cascade.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return prefix_forest.search(vectors, vectors.where("vec_id % 100 = 0"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_quality, op4_html, op5_line_dedup, op6_chat, op7_licenses, op8_quality_rules, op9_neighbours, op10_packing)}
ORACLE_SQL: dict[str, str] = {k: v for k, v in ORACLES.items() if k in QUERIES}
