"""Document metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import characters, rate, ratio, utf8_bytes
from ..functions.text import count_tables
from .assemble import joined

COUNTERS = ("ocr_applied", "ocr_text_chars", "multi_column_detected", "reading_order_warnings", "header_footer_removed_count")


def document_metrics(pages: DataFrame, keys: list[str], elapsed: DataFrame | None = None) -> DataFrame:
    """Pages (page_number, markdown_content, and where there are such tables, images and the recognition counters)
    to a row of 17 measures for each document. tables: array<any>; images: array<struct<caption string, ...>>;
    elapsed: keys and elapsed_seconds. Tables are counted in the Markdown where no page has any of its own. Page
    marker coverage and the chunk measures stay 0: nothing computes them."""
    have = set(pages.columns)
    number = lambda c: F.sum(F.size(c)) if c in have else F.lit(0)
    captions = F.sum(F.size(F.filter("images", lambda i: F.length(F.coalesce(i["caption"], F.lit(""))) > 0))) if "images" in have else F.lit(0)
    flag = lambda c: (F.coalesce(F.bool_or(c), F.lit(False)) if c in have else F.lit(False)).alias(c)
    total = lambda c: (F.coalesce(F.sum(c), F.lit(0)) if c in have else F.lit(0)).cast("long").alias(c)
    docs = pages.groupBy(*keys).agg(
        F.count("*").cast("int").alias("page_count"), joined(F.col("page_number"), F.col("markdown_content")).alias("_md"), F.coalesce(number("tables"), F.lit(0)).alias("_tables"),
        F.coalesce(number("images"), F.lit(0)).cast("long").alias("image_count"), F.coalesce(captions, F.lit(0)).cast("long").alias("caption_count"),
        flag("ocr_applied"), total("ocr_text_chars"), flag("multi_column_detected"), total("reading_order_warnings"), total("header_footer_removed_count"),
    )
    docs = docs.join(elapsed, keys, "left") if elapsed is not None else docs.withColumn("elapsed_seconds", F.lit(0.0))
    return measures(docs, keys)


def measures(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row of 17 measures of each document's row: its counts, its Markdown (_md) and its own tables (_tables)."""
    seconds = F.coalesce("elapsed_seconds", F.lit(0.0))
    return docs.select(
        *keys, F.bround(seconds, 4).alias("elapsed_seconds"), "page_count", rate(F.col("page_count"), seconds).alias("pages_per_second"), utf8_bytes(F.col("_md")).alias("output_bytes"),
        characters(F.col("_md")).alias("markdown_chars"), F.when(F.col("_tables") > 0, F.col("_tables")).otherwise(count_tables(F.col("_md"))).cast("long").alias("table_count"), "image_count",
        F.lit(0).alias("chunk_count"), F.lit(0.0).alias("chunks_with_page_numbers_ratio"), F.lit(0.0).alias("page_marker_coverage"), *COUNTERS, "caption_count",
        ratio(F.col("caption_count"), F.col("image_count")).alias("images_with_caption_ratio"),
    )
