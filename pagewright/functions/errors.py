"""Error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_TYPES = (
    "dependency_missing", "file_not_found", "unsupported_format", "engine_unavailable", "engine_timeout", "parse_failed",
    "quality_check_failed", "ocr_unavailable", "layout_quality_warning", "table_extraction_failed",
)


def classify(kind: Column, message: Column) -> Column:
    """An exception's class by its kind's name and its message. The first rule that holds decides."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *parts: F.lit(True) if not parts else m.contains(parts[0]) & has(*parts[1:])
    return (
        F.when(kind == "FileNotFoundError", "file_not_found")
        .when(kind.isin("ImportError", "ModuleNotFoundError"), "dependency_missing")
        .when(has("unsupported file extension"), "unsupported_format")
        .when(has("cuda", "not available"), "engine_unavailable")
        .when(has("unable to start local mineru-api"), "engine_unavailable")
        .when(has("timed out") | has("timeout"), "engine_timeout")
        .when(has("ocr", "unavailable"), "ocr_unavailable")
        .when(has("table", "failed"), "table_extraction_failed")
        .otherwise("parse_failed")
    )
