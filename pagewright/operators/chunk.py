"""The semantic chunker: Markdown documents to sections with their header path and pages.

A header may run across white space with newlines, fences aren't honoured, and the marker of a page
that begins with a header belongs to the section before it: that is the contract. One shuffle by document, none
if the documents came from an aggregation by the same keys; no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEADER, HEADER_AT_START, marker_pages, strip, without_markers

_ESCAPE = "\ue000"
_CUT = _ESCAPE + "1"
CHUNK_COLUMNS = ("chunk_index", "content", "header", "header_level", "header_path", "page_numbers")


def chunk(docs: DataFrame, keys: list[str], content: str = "content", drop_empty: bool = False) -> DataFrame:
    """docs' other columns, overlaid by chunk_index, content, header, header_level, header_path and page_numbers.
    A null document counts as an empty one, whose single chunk is empty. drop_empty: without chunks of no content."""
    carried = [c for c in docs.columns if c != content and c not in CHUNK_COLUMNS]
    # an escaped text can't hold the mark that sections are cut at
    escaped = F.replace(F.coalesce(F.col(content), F.lit("")), F.lit(_ESCAPE), F.lit(_ESCAPE + "0"))
    parts = F.split(F.regexp_replace(escaped, HEADER, _CUT + "$0"), _CUT)
    cut = docs.select(*keys, *(c for c in carried if c not in keys), parts.alias("_parts"))
    cut = cut.select("*", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_at", "_raw")).drop("_parts")
    raw = F.replace(F.col("_raw"), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    cut = cut.withColumn("_raw", raw)
    headed = F.col("_at") > 0
    cut = cut.select(
        "*", F.when(headed, F.length(F.regexp_extract("_raw", HEADER_AT_START, 1))).otherwise(0).alias("_level"),
        F.when(headed, strip(F.regexp_extract("_raw", HEADER_AT_START, 2))).alias("_title"), marker_pages(F.col("_raw")).alias("_pages"),
    )
    w = Window.partitionBy(*keys).orderBy("_at")
    here, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("_level") == k, F.struct("_at", "_title")), ignorenulls=True).over(here).alias(f"_l{k}") for k in range(1, 7)]
    page = F.coalesce(F.last(F.when(F.size("_pages") > 0, F.element_at("_pages", -1)), ignorenulls=True).over(before), F.lit(1)).alias("_page")
    seen = cut.select("*", *last, page)
    live = []
    for k in range(1, 7):
        at = F.col(f"_l{k}._at")
        over = reduce(lambda a, b: a & b, [F.col(f"_l{j}._at").isNull() | (F.col(f"_l{j}._at") < at) for j in range(1, k)], F.lit(True))
        live.append(F.when(over, F.col(f"_l{k}._title")))
    kept = seen.where((F.col("_at") > 0) | (F.col("_n") == 1) | (F.length(strip(F.col("_raw"))) > 0))
    out = kept.select(
        *keys, *(c for c in carried if c not in keys), "_at", without_markers(F.col("_raw")).alias("content"), F.col("_title").alias("header"),
        F.col("_level").alias("header_level"), F.concat_ws(" > ", *live).alias("header_path"),
        F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("_page"), "_pages")))).alias("page_numbers"),
    )
    if drop_empty:
        out = out.where(F.length("content") > 0)
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("_at")) - 1).alias("chunk_index")
    return out.select(*keys, *(c for c in carried if c not in keys), number, "content", "header", "header_level", "header_path", "page_numbers")
