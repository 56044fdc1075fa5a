"""Queries over the driver's tables, one for each operator of the document engine.

The tables hold no Markdown, so each query first makes its documents of relational rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import render as M
from ..functions.errors import classify
from ..functions.metrics import rate, ratio
from ..functions.text import count_tables, marker_pages, page_marker, without_markers
from ..operators.assemble import documents, element_pages, joined, quality_rollup
from ..operators.batch import with_todo
from ..operators.chunk import chunk
from ..operators.metrics import document_metrics
from ..operators.normalise import reply_pages
from ..operators.quality import quality_checks
from ..operators.summary import batch_summary, benchmark_summary
from . import files


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def conversation_pages(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    head = F.when(F.col("turn") == 0, F.concat(F.lit("# Conversation "), _s("conv_id"), F.lit("\n\n"))).otherwise("")
    md = F.concat(head, F.lit("## "), "role", F.lit(" "), _s("turn"), F.lit("\n"), "text")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), md.alias("markdown_content"))


def conversation_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(conversation_pages(spark, d), ["doc_id"]).select("doc_id", "content")
    return chunk(docs, ["doc_id"]).withColumn("page_numbers", F.array_join("page_numbers", ","))


def catalog_chunks_nested(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer = (_t(spark, d, n) for n in ("region", "nation", "customer"))
    segments = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    text = F.concat(F.lit("\n#### "), "c_mktsegment", F.lit("\n"), _s("n"), F.lit(" customers"))
    per_nation = segments.groupBy("c_nationkey").agg(joined(F.col("c_mktsegment"), text, "").alias("segments"))
    nations = nation.join(per_nation, nation["n_nationkey"] == per_nation["c_nationkey"], "left")
    body = F.concat(F.lit("\n## "), "n_name", F.lit("\n"), page_marker(F.col("n_nationkey") + 2), F.lit("\nKey "), _s("n_nationkey"), F.coalesce("segments", F.lit("")))
    per_region = nations.groupBy("n_regionkey").agg(joined(F.col("n_name"), body, "").alias("nations"))
    docs = region.join(per_region, region["r_regionkey"] == per_region["n_regionkey"], "left")
    content = F.concat(F.lit("Preface\n# "), "r_name", F.coalesce("nations", F.lit("")))
    chunks = chunk(docs.select(F.col("r_regionkey").alias("doc_id"), content.alias("content")), ["doc_id"])
    return chunks.withColumn("page_numbers", F.array_join("page_numbers", ","))


def _rows(df: DataFrame, columns: list[str], order: str, keys: list[str]) -> DataFrame:
    """keys and rows: the table's head and body as array<array<string>>."""
    cells = F.array(*(_s(c) for c in columns))
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("c")))), lambda r: r["c"])
    return df.groupBy(*keys).agg(F.concat(F.array(F.array(*(F.lit(c) for c in columns))), body).alias("rows"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(_t(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey", ["n_regionkey"])
    return rows.select("n_regionkey", M.table(F.col("rows")).alias("markdown"))


def sheet_document(spark: SparkSession, d: str) -> DataFrame:
    sheets = (("region", "r_regionkey", ["r_regionkey", "r_name"]), ("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]), ("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"]))
    pages = None
    for k, (name, order, columns) in enumerate(sheets):
        rows = _rows(_t(spark, d, name).withColumn("doc", F.lit("workbook")), columns, order, ["doc"])
        page = rows.select("doc", F.lit(k + 1).alias("page_number"), M.sheet(F.lit(name), M.table(F.col("rows"))).alias("markdown_content"))
        pages = page if pages is None else pages.unionByName(page)
    return documents(pages, ["doc"]).select("doc", "content", F.col("page_count").cast("long").alias("page_count"))


def block_markdown(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    k = F.pmod("p_partkey", F.lit(7))
    style = F.element_at(F.array(*map(F.lit, ("Title", "Heading 1", "heading 2", "Heading 3", "List Bullet", "Normal", "Heading 4"))), (k + 1).cast("int"))
    text = F.when(F.pmod("p_partkey", F.lit(11)) == 0, F.lit(" \n")).otherwise(F.concat(F.lit("  "), "p_name", F.lit("\t")))
    b = part.select("p_brand", "p_partkey", M.block(style, text).alias("line"))
    body = joined(F.col("p_partkey"), F.concat("line", F.lit("\n")))
    return b.where("line is not null").groupBy(F.col("p_brand").alias("doc_id")).agg(body.alias("markdown"), F.count("*").alias("blocks"))


def _synthetic(spark: SparkSession, d: str) -> DataFrame:
    """Documents with no to two tables of two columns and one of a single column, which doesn't count."""
    docs = _t(spark, d, "documents")
    two = F.lit("\n\n| a | b |\n| --- | :---: |\n| 1 | 2 |")
    times = F.pmod("doc_id", F.lit(3)).cast("int")
    return docs.select("doc_id", "source", "lang", F.concat("text", F.repeat(two, times), F.lit("\n\n| A |\n| --- |\n| 1 |")).alias("content"))


def table_count(spark: SparkSession, d: str) -> DataFrame:
    return _synthetic(spark, d).select("doc_id", count_tables(F.col("content")).cast("long").alias("table_count"))


def doc_metrics(spark: SparkSession, d: str) -> DataFrame:
    return document_metrics(conversation_pages(spark, d), ["doc_id"]).select(
        "doc_id", F.col("page_count").cast("long").alias("page_count"), "output_bytes", "markdown_chars", "table_count", "image_count", "caption_count"
    )


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(conversation_pages(spark, d), ["doc_id"]).select("doc_id", "content")
    return chunk(docs, ["doc_id"]).groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.max("header_level").cast("long").alias("max_level"), F.sum(F.size("page_numbers")).cast("long").alias("page_refs"),
        F.count_if(F.size("page_numbers") > 1).alias("spanning_chunks"), F.sum(F.length("content")).cast("long").alias("content_chars"),
    )


ERROR_CASES = (
    ("FileNotFoundError", "no such file: "), ("ImportError", "missing module for "), ("ValueError", "Unsupported file extension: ."), ("RuntimeError", "CUDA is not available for "),
    ("RuntimeError", "Unable to start local mineru-api for "), ("RuntimeError", "request timed out on "), ("RuntimeError", "OCR model unavailable: "), ("RuntimeError", "table extraction failed in "),
    ("RuntimeError", "something else with "),
)


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    k = (F.pmod("event_id", F.lit(len(ERROR_CASES))) + 1).cast("int")
    kind = F.element_at(F.array(*(F.lit(c) for c, _ in ERROR_CASES)), k)
    message = F.concat(F.element_at(F.array(*(F.lit(m) for _, m in ERROR_CASES)), k), "event_type")
    return _t(spark, d, "events").groupBy(classify(kind, message).alias("error_type"), "event_type").agg(F.count("*").alias("n"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Each labelled document's metrics with thresholds that depend on its label."""
    docs = _synthetic(spark, d)
    pages = docs.select("doc_id", F.lit(1).alias("page_number"), F.col("content").alias("markdown_content"), (F.pmod("doc_id", F.lit(5)) == 0).alias("ocr_applied"),
                        F.when(F.pmod("doc_id", F.lit(5)) == 0, F.pmod("doc_id", F.lit(4))).alias("ocr_text_chars"), (F.pmod("doc_id", F.lit(2)) == 0).alias("multi_column_detected"),
                        F.pmod("doc_id", F.lit(3)).alias("reading_order_warnings"), F.pmod("doc_id", F.lit(4)).alias("header_footer_removed_count"))
    checks = _t(spark, d, "labels").select(
        "doc_id", F.lit(1).alias("min_pages"), F.when(F.col("quality") == 1, 1000).alias("min_chars"), F.lit(1).alias("min_tables"),
        (F.col("quality") == 0).alias("require_ocr_text"), (F.col("toxic") == 1).alias("require_table_markdown"), F.lit(True).alias("require_multi_column_check"),
        F.when(F.col("toxic") == 1, 0.15).alias("max_header_footer_repetition"),
    )
    return quality_checks(document_metrics(pages, ["doc_id"]).join(checks, "doc_id"))


def quality_check_rows(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("doc_id", "passed", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents").select("doc_id", "source", "n_chars"), _t(spark, d, "labels")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "skipped").otherwise("success")
    ok = status == "success"
    return docs.join(labels, "doc_id", "left").select(
        F.concat("source", F.lit("/"), F.lpad(_s("doc_id"), 12, "0"), F.lit(".pdf")).alias("source"), status.alias("status"),
        F.when(ok, F.ceil(F.col("n_chars") / 1000)).alias("page_count"), F.when(ok, F.col("n_chars") / 1024).alias("elapsed_seconds"),
    )


def batch_summary_row(spark: SparkSession, d: str) -> DataFrame:
    return batch_summary(_items(spark, d)).select(
        "total_files", "success_count", "failed_count", "skipped_count", "total_pages", F.round("average_pages_per_second", 3).alias("average_pages_per_second"), F.array_join("failed_sources", ",").alias("failed_sources")
    )


def benchmark_summary_row(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("success").alias("status"))
    rows = _checked(spark, d).join(labels, "doc_id").withColumn("id", F.lpad(_s("doc_id"), 12, "0"))
    failed = F.col("status") == "failed"
    measures = ("table_count", "image_count", "ocr_applied", "reading_order_warnings", "header_footer_removed_count", "passed")
    rows = rows.select("id", "status", *(F.when(~failed, F.col(c)).alias(c) for c in measures))
    return benchmark_summary(rows).withColumn("failed_samples", F.array_join("failed_samples", ",")).withColumn("quality_failed_samples", F.array_join("quality_failed_samples", ","))


def skip_existing(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a batch whose output is there if they are labelled."""
    listed = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("in/"), _s("doc_id"), F.lit(".pdf")).alias("source"))
    listed = listed.withColumn("name", P.output_name(F.col("source"), "markdown"))
    there = _t(spark, d, "labels").select(F.concat(_s("doc_id"), F.lit(".md")).alias("name"))
    return with_todo(listed, there).select("doc_id", F.when(F.col("todo"), "success").otherwise("skipped").alias("status"))


def element_page_groups(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem")
    text = F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat("l_returnflag", F.lit(" "), _s("l_partkey")))
    elements = lines.select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") > 5, None).otherwise(F.col("l_linenumber") % 3).alias("page_idx"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("pos"),
        F.when(F.col("l_linestatus") == "O", "title").alias("kind"), text.alias("text"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("whole").alias("md"),
    )
    pages = element_pages(elements, ["doc_id"], "md")
    return pages.select("doc_id", F.col("page_number").cast("long").alias("page_number"), "markdown_content", "plain_text", F.array_join(F.transform("elements", lambda e: e["kind"]), ",").alias("kinds"))


def service_replies(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem")
    element = F.struct((F.col("l_linenumber") % 3).alias("page_idx"), F.col("l_returnflag").alias("text"), F.lit("table").alias("type"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", element.alias("e")))), lambda r: r["e"])
    grouped = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(items.alias("content_list"))
    inner = F.struct(F.concat(F.lit("order "), _s("doc_id")).alias("md"), F.when(F.col("doc_id") % 5 != 0, F.col("content_list")).alias("content_list"))
    replies = grouped.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.to_json(inner)).otherwise(F.to_json(F.struct(inner.alias("result")))).alias("reply"))
    pages = reply_pages(replies, ["doc_id"])
    return pages.select("doc_id", F.col("page_number").cast("long").alias("page_number"), "markdown_content", "plain_text", F.size("elements").cast("long").alias("n_elements"))


def quality_rollup_rows(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    pages = e.select(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type") == "click").alias("ocr_applied"), F.when(F.col("event_id") % 4 != 0, F.length("event_type")).alias("ocr_text_chars"),
        (F.col("event_id") % 97 == 0).alias("multi_column_detected"), (F.col("event_id") % 2).alias("reading_order_warnings"), F.lit(None).cast("int").alias("header_footer_removed_count"),
    )
    return quality_rollup(pages, ["user_id"])


SUFFIXES = (".pdf", ".DOCX", ".doc", ".xlsx", ".XLS", ".csv", ".md", ".txt", ".html", "")


def route_by_extension(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.pmod("doc_id", F.lit(len(SUFFIXES))) + 1).cast("int"))
    path = F.concat(F.lit("/in/"), "source", F.lit("/v1.doc-"), _s("doc_id"), suffix)
    files = _t(spark, d, "documents").select("doc_id", path.alias("path"))
    p = F.col("path")
    return files.select("doc_id", P.extension(p).alias("extension"), F.coalesce(P.family(p), F.lit("unsupported")).alias("family"), P.output_name(p, "markdown").alias("output"))


def marker_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Markers before, within, between and after two copies of each whole text: which they are, the text without them, and every chunk's pages."""
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", "text")
    k, half = F.pmod("doc_id", F.lit(6)).cast("int"), (F.length("text") / 2).cast("int")
    parts = [page_marker(k + 3), F.substring("text", F.lit(1), half), page_marker(k + 1), F.substring("text", half + 1, F.length("text")), page_marker(k + 3), "text", F.lit("<!--page_number:  9-->")]
    docs = docs.select("doc_id", F.concat(*parts).alias("content"))
    pages = chunk(docs, ["doc_id"]).groupBy("doc_id").agg(joined(F.col("chunk_index"), F.array_join("page_numbers", ","), ";").alias("pages"))
    both = docs.select("doc_id", F.array_join(marker_pages(F.col("content")), ",").alias("markers"), without_markers(F.col("content")).alias("clean"))
    return both.join(pages, "doc_id")


def rates(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 64).alias("pages"), ((F.col("event_id") % 9) / 8).alias("seconds"))
    return e.select("event_id", F.round(rate(F.col("pages"), F.col("seconds")), 3).alias("rate"), F.round(ratio(F.col("pages"), F.lit(64)), 3).alias("ratio"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "conversation_chunks": conversation_chunks,
    "catalog_chunks_nested": catalog_chunks_nested,
    "table_markdown": table_markdown,
    "sheet_document": sheet_document,
    "block_markdown": block_markdown,
    "table_count": table_count,
    "doc_metrics": doc_metrics,
    "chunk_stats": chunk_stats,
    "error_classes": error_classes,
    "quality_checks": quality_check_rows,
    "batch_summary": batch_summary_row,
    "benchmark_summary": benchmark_summary_row,
    "skip_existing": skip_existing,
    "element_pages": element_page_groups,
    "service_replies": service_replies,
    "quality_rollup": quality_rollup_rows,
    "route_by_extension": route_by_extension,
    "marker_ranges": marker_ranges,
    "rates": rates,
    **files.QUERIES,
}
