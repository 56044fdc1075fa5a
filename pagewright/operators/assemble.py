"""Pages to documents, and layout elements to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import marked_page


def joined(order: Column, text: Column, separator: str = "\n") -> Column:
    """An aggregate: texts in their order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def documents(pages: DataFrame, keys: list[str], number: str = "page_number", markdown: str = "markdown_content") -> DataFrame:
    """keys, markdown_content (pages joined) and content (pages behind their markers), and page_count."""
    n, m = F.col(number), F.col(markdown)
    return pages.groupBy(*keys).agg(
        joined(n, m).alias("markdown_content"), joined(n, marked_page(n, m)).alias("content"), F.count("*").cast("int").alias("page_count")
    )


def element_pages(elements: DataFrame, keys: list[str], fallback: str | None = None) -> DataFrame:
    """(keys, page_idx, pos, kind, text, bbox) to pages: elements in their order, the non-empty texts joined; a page
    without any takes the document's Markdown (the fallback column). A row without pos is a page without elements."""
    there = F.col("pos").isNotNull()
    text = F.when(there & (F.length("text") > 0), F.col("text"))
    element = F.struct("pos", F.coalesce("kind", F.lit("text")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "bbox")
    rows = F.array_sort(F.collect_list(F.when(there, element)))
    whole = F.coalesce(F.first(F.col(fallback)), F.lit("")) if fallback else F.lit("")
    placed = elements.withColumn("page_idx", F.coalesce("page_idx", F.lit(0)).cast("int"))
    grouped = placed.groupBy(*keys, "page_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("pos", text.alias("t"))))), lambda r: r["t"]), "\n").alias("plain_text"),
        F.transform(rows, lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text"), r["bbox"].alias("bbox"))).alias("elements"),
        whole.alias("whole"),
    )
    return grouped.select(
        *keys, (F.col("page_idx") + 1).alias("page_number"),
        F.when(F.length("plain_text") > 0, F.col("plain_text")).otherwise(F.col("whole")).alias("markdown_content"), "plain_text", "elements",
    )


def quality_rollup(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages' recognition counters for each document; what is missing counts as 0 or false."""
    any_of = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False)).alias(c)
    total = lambda c: F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("long").alias(c)
    return pages.groupBy(*keys).agg(
        any_of("ocr_applied"), total("ocr_text_chars"), any_of("multi_column_detected"), total("reading_order_warnings"), total("header_footer_removed_count")
    )
