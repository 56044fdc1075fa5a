"""Declarative quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKS = T.StructType(
    [T.StructField(f"min_{x}", T.IntegerType()) for x in ("pages", "chars", "tables", "images")]
    + [T.StructField("max_header_footer_repetition", T.DoubleType())]
    + [T.StructField(f"require_{x}", T.BooleanType()) for x in ("page_markers", "table_markdown", "ocr_text", "multi_column_check", "captions_for_images")]
)


def quality_checks(measured: DataFrame) -> DataFrame:
    """Adds passed, failures and warnings to rows that hold both metrics and checks. A threshold that is null is
    off, as is a demand that is null or false. Failures come in a fixed order."""
    have = set(measured.columns)
    c = lambda name: F.col(name) if name in have else F.lit(None)
    on = lambda name: F.coalesce(c(name).cast("boolean"), F.lit(False))
    under = lambda name, measure: F.coalesce(F.col(measure) < c(name), F.lit(False))
    rules: list[tuple[str, Column]] = [
        ("min_pages", under("min_pages", "page_count")),
        ("min_chars", under("min_chars", "markdown_chars")),
        ("min_tables", under("min_tables", "table_count")),
        ("min_images", under("min_images", "image_count")),
        ("require_page_markers", on("require_page_markers") & (F.col("page_marker_coverage") <= 0)),
        ("require_table_markdown", on("require_table_markdown") & (F.col("table_count") <= 0)),
        ("require_ocr_text", on("require_ocr_text") & (F.col("ocr_text_chars") <= 0)),
        ("require_multi_column_check", on("require_multi_column_check") & ~F.col("multi_column_detected") & (F.col("reading_order_warnings") <= 0)),
        ("require_captions_for_images", on("require_captions_for_images") & (F.col("image_count") > 0) & (F.col("images_with_caption_ratio") < 1)),
    ]
    failures = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
    unfiltered = c("max_header_footer_repetition").isNotNull() & (F.col("header_footer_removed_count") == 0)
    warnings = F.array_compact(F.array(F.when(unfiltered, F.lit("header_footer_filter_not_applied"))))
    return measured.select("*", failures.alias("failures"), warnings.alias("warnings")).withColumn("passed", F.size("failures") == 0)
