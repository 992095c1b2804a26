"""Fetched-page sources (S1, S5, S6) and the extracted page table.

``pages_extracted`` turns the driver's ``pages`` table (page_id, url, html)
into the canonical page schema used by the rule engine, keyed by
``site`` = host without ``www.``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import spread, stored, table_path
from .html import PAGE_FIELDS, extract_pages

PAGE_COLUMNS = ["site", "ord", "url", "title", "description", "content", "headings", "code_blocks", "links",
                "has_tables"]


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "pages"))


def pages_extracted(spark: SparkSession, sf_dir: str, strip_chrome: bool = False, columns: tuple[str, ...] = PAGE_FIELDS) -> DataFrame:
    """All pages as page columns (one narrow projection; only ``columns`` are built), with ``site`` and ``ord``."""
    ex = extract_pages(spread(raw_pages(spark, sf_dir)), keep=("page_id",), strip_chrome=strip_chrome, columns=columns)
    return ex.select(U.site_name("url").alias("site"), F.col("page_id").alias("ord"), "*").drop("page_id")


def pages_stored(spark: SparkSession, sf_dir: str, strip_chrome: bool = False, columns: tuple[str, ...] = PAGE_FIELDS) -> DataFrame:
    """``pages_extracted`` written once to the shared folder, for plans that read pages more than once."""
    return stored(pages_extracted(spark, sf_dir, strip_chrome, columns), "pages")


def read_fetched_pages(fetched: DataFrame, key: str = "page_id", strip_chrome: bool = False) -> DataFrame:
    """Responses (key, url, body, status?, content_type?) to page rows, in one projection.

    Keeps status 200 (or no status); html / xhtml / missing / unknown content
    types go through HTML extraction; text/markdown and text/plain bodies are
    the content with no other fields.  ``ord`` is the caller's ``key``, which
    does not change when a task is run again.
    """
    df = fetched
    if "status" in df.columns:
        df = df.where(F.col("status").isNull() | (F.col("status") == 200))
    ctype = F.lower(F.coalesce(F.col("content_type"), F.lit(""))) if "content_type" in df.columns else F.lit("")
    is_text = (~ctype.contains("text/html") & ~ctype.contains("xhtml") & (ctype != "")) & \
        (ctype.contains("text/markdown") | ctype.contains("text/plain"))
    df = df.select(F.col(key).alias("_rid"), "url", F.when(is_text, F.col("body")).alias("_plain"), F.when(~is_text, F.col("body")).alias("html"))
    out = extract_pages(df, keep=("_rid", "_plain"), strip_chrome=strip_chrome)
    out = out.withColumn("content", F.coalesce("_plain", "content"))
    return out.select(U.site_name("url").alias("site"), F.col("_rid").alias("ord"), "*").drop("_rid", "_plain")


def per_site_page_cap(pages: DataFrame, n: int | None) -> DataFrame:
    """First n pages of each site in crawl order (``ord``); None = no cap."""
    if n is None:
        return pages
    w = Window.partitionBy("site").orderBy("ord")
    return pages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def min_content_filter(pages: DataFrame, min_chars: int = 50) -> DataFrame:
    """Drop pages whose stripped content has at most ``min_chars`` characters."""
    stripped = F.regexp_replace(F.coalesce(F.col("content"), F.lit("")), r"^(?U)\s+|(?U)\s+$", "")
    return pages.where(F.length(stripped) > min_chars)
