"""HTML extraction by consensus host paths.

Each page scores its containers and votes with the generalised path of its
best one; Spark counts the votes of each host; each page is then extracted
again from the containers at its host's winning path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html_page
from .common import small, written


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, pages, score)``: how many pages of a host have their best container at a path, and their scores' sum."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores = [], []
            for source in batch.column(1):
                page = html_page.parse(source.as_py())
                found = page.elements[html_page.best(page)]
                paths.append(found.path)
                scores.append(round(found.score))
            yield pa.record_batch([batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    voted = rows.mapInArrow(of, "host string, path string, score long").where("score > 0")
    return voted.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("score").alias("score"))


def winners(counted: DataFrame) -> DataFrame:
    """``(host, path)``: most pages, then highest score, then the path last by code point."""
    best = F.max(F.struct("pages", "score", "path")).alias("best")
    return counted.groupBy("host").agg(best).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)`` for each row of ``pages``.

    text: blocks of the containers at the winning path of the page's host,
    or of the page's own best container where it has none there with text;
    joined by two line feeds. Empty for null, empty and textless pages.
    Pages without a host are one host. Repeated rows each come back; other
    columns are not read; an empty table gives none.
    """
    won = written(winners(votes(pages, url_col, html_col)), "paths")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    rows = rows.join(small(won, won.count()), "host", "left").select("page_id", "url", "html", "path")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path in zip(batch.column(2), batch.column(3).to_pylist()):
                page = html_page.parse(source.as_py())
                found = html_page.blocks(page, html_page.at_path(page, path)) if path else []
                texts.append("\n\n".join(found or html_page.blocks(page, [html_page.best(page)])))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(of, "page_id long, url string, text string")
