"""Batch and benchmark summaries: one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import rate


def _count(condition: Column, name: str) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long").alias(name)


def _listed(condition: Column, value: str) -> Column:
    return F.array_sort(F.collect_list(F.when(condition, F.col(value))))


def batch_summary(items: DataFrame) -> DataFrame:
    """items: source, status, page_count and elapsed_seconds (null without metrics)."""
    status, pages = F.col("status"), F.coalesce(F.sum("page_count"), F.lit(0))
    seconds = F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0))
    return items.agg(
        F.count("*").alias("total_files"), _count(status == "success", "success_count"), _count(status == "failed", "failed_count"), _count(status == "skipped", "skipped_count"),
        pages.cast("long").alias("total_pages"), F.bround(seconds, 4).alias("total_elapsed_seconds"), rate(pages, seconds).alias("average_pages_per_second"),
        _listed(status == "failed", "source").alias("failed_sources"),
    )


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """rows: id, status, passed (null without checks) and, null without metrics, the measures."""
    status, passed = F.col("status"), F.col("passed")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("total_samples"), _count(status == "success", "success_count"), _count(status == "failed", "failed_count"),
        _count(passed, "quality_passed_count"), _count(~passed, "quality_failed_count"),
        _listed(status == "failed", "id").alias("failed_samples"), _listed(~passed, "id").alias("quality_failed_samples"),
        total("table_count").alias("total_tables"), total("image_count").alias("total_images"), _count(F.col("ocr_applied"), "ocr_applied_count"),
        total("reading_order_warnings").alias("reading_order_warning_count"), total("header_footer_removed_count").alias("header_footer_removed_count"),
    )
