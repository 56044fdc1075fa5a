import json

from pyspark.sql import functions as F

from pagewright import batch_summary, benchmark_summary, chunk, document_metrics, quality_checks, quality_rollup, reply_pages
from pagewright.functions import paths as P
from pagewright.functions import render as M
from pagewright.functions.errors import ERROR_TYPES, classify
from pagewright.functions.metrics import rate
from pagewright.functions.text import count_tables, marker_pages, page_marker, unify_newlines, without_markers


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


def test_tables_are_counted(spark):
    t = "\n".join(["| K | L |", "|---|:---|", "| 5 | 6 |", ""])
    rows = spark.createDataFrame([(t + "\n" + t, 2), ("| A |\n| --- |", 0), ("", 0), (None, 0), ("a\x85:---:|---", 1), ("--|--", 0)], "t string, n int")
    assert all(r.c == r.n for r in rows.select("n", count_tables(F.col("t")).alias("c")).collect())


def test_rate_rounds_half_even_and_guards_zero(spark):
    rows = spark.createDataFrame([(3, 0.0, 0.0), (5, 2.0, 2.5), (1, 3.0, 0.3333)], "p int, s double, w double")
    assert all(r.r == r.w for r in rows.select("w", rate(F.col("p"), F.col("s")).alias("r")).collect())


def test_blocks_and_tables(spark):
    rows = spark.createDataFrame([("Subtitle", " x ", "# x"), ("Heading 10", "x", "# x"), ("heading 2", "x", "## x"), ("Heading 4", "x", "x"), ("List Bullet", "x", "- x"), ("Normal", " ", None), (None, "x", "x")], "s string, t string, w string")
    assert all(r.b == r.w for r in rows.select("w", M.block(F.col("s"), F.col("t")).alias("b")).collect())
    got = spark.createDataFrame([([["A", " b\nc "], [None, "2"]],), ([],)], "rows array<array<string>>").select(M.table(F.col("rows")).alias("t")).collect()
    assert [r.t for r in got] == ["| A | b c |\n| --- | --- |\n|  | 2 |", None]
    assert one(spark, M.page(F.lit("Report"), F.array(F.array(F.array(F.lit("K"), F.lit("L")), F.array(F.lit("5"), F.lit("6")))))) == "\n".join(["Report", "", "| K | L |", "| --- | --- |", "| 5 | 6 |"])


def test_newlines(spark):
    assert one(spark, unify_newlines(F.lit("a\r\nb\rc\n"))) == "a\nb\nc\n"


def test_paths(spark):
    rows = spark.createDataFrame([("/a/b.PDF", ".pdf", "b", "pdf"), ("c.tar.gz", ".gz", "c.tar", None), ("/x/.hidden", "", ".hidden", None), ("n", "", "n", None)], "p string, e string, s string, f string")
    p = F.col("p")
    for r in rows.select("*", P.extension(p).alias("e2"), P.stem(p).alias("s2"), P.family(p).alias("f2")).collect():
        assert (r.e2, r.s2, r.f2) == (r.e, r.s, r.f)
    assert P.distinct_outputs(["team-a/report.pdf", "team-b/report.pdf"]) == ["team-a/report.md", "team-b/report.md"]
    assert P.distinct_outputs(["/x/a/r.pdf", "/x/b/r.pdf", "/x/b/r.pdf", "/x/b/r.pdf"]) == ["r.md", "b/r.md", "x/b/r.md", "r-1.md"]


def test_error_classes(spark):
    cases = [
        ("FileNotFoundError", "x", "file_not_found"), ("ImportError", "x", "dependency_missing"), ("ValueError", "Unsupported file extension: .x", "unsupported_format"), ("RuntimeError", "CUDA is not available", "engine_unavailable"),
        ("RuntimeError", "Timed out", "engine_timeout"), ("RuntimeError", "OCR unavailable", "ocr_unavailable"), ("RuntimeError", "table x failed", "table_extraction_failed"), ("RuntimeError", None, "parse_failed"),
    ]
    for r in spark.createDataFrame(cases, "k string, m string, w string").select("w", classify(F.col("k"), F.col("m")).alias("c")).collect():
        assert r.c == r.w and r.c in ERROR_TYPES


def test_document_metrics_and_quality(spark):
    schema = "doc_id int, page_number int, markdown_content string, tables array<array<array<string>>>, images array<struct<caption:string>>, ocr_applied boolean, ocr_text_chars int"
    pages = spark.createDataFrame([(1, 1, "é", [[["a"]]], [(None,)], True, 12)], schema)
    elapsed = spark.createDataFrame([(1, 2.0)], "doc_id int, elapsed_seconds double")
    m = document_metrics(pages, ["doc_id"], elapsed)
    r = m.first()
    assert (r.page_count, r.pages_per_second, r.output_bytes, r.markdown_chars, r.table_count, r.image_count, r.caption_count, r.ocr_applied, r.ocr_text_chars) == (1, 0.5, 2, 1, 1, 1, 0, True, 12)
    checks = m.select("*", F.lit(2).alias("min_pages"), F.lit(True).alias("require_page_markers"), F.lit(True).alias("require_captions_for_images"), F.lit(True).alias("require_multi_column_check"), F.lit(0.1).alias("max_header_footer_repetition"))
    q = quality_checks(checks).first()
    assert not q.passed and q.failures == ["min_pages", "require_page_markers", "require_multi_column_check", "require_captions_for_images"] and q.warnings == ["header_footer_filter_not_applied"]
    assert quality_checks(m).first().passed


def test_summaries(spark):
    items = spark.createDataFrame([("b", "success", 3, 2.0), ("a", "failed", None, None), ("c", "skipped", None, None)], "source string, status string, page_count int, elapsed_seconds double")
    r = batch_summary(items).first()
    assert (r.total_files, r.success_count, r.failed_count, r.skipped_count, r.total_pages, r.average_pages_per_second, r.failed_sources) == (3, 1, 1, 1, 3, 1.5, ["a"])
    assert batch_summary(items.where("false")).first().average_pages_per_second == 0.0
    rows = spark.createDataFrame([("x", "success", True, 2, 1, True, 1, 0), ("y", "failed", None, None, None, None, None, None), ("z", "success", False, 1, 0, False, 0, 4)],
                                 "id string, status string, passed boolean, table_count int, image_count int, ocr_applied boolean, reading_order_warnings int, header_footer_removed_count int")
    b = benchmark_summary(rows).first()
    assert (b.quality_passed_count, b.quality_failed_count, b.failed_samples, b.quality_failed_samples, b.total_tables, b.ocr_applied_count, b.header_footer_removed_count) == (1, 1, ["y"], ["z"], 3, 1, 4)


def test_rollup(spark):
    pages = spark.createDataFrame([(1, True, 10, True, 1, 2), (1, None, None, None, None, None), (2, None, None, None, None, None)], "doc_id int, ocr_applied boolean, ocr_text_chars int, multi_column_detected boolean, reading_order_warnings int, header_footer_removed_count int")
    got = {r.doc_id: tuple(r)[1:] for r in quality_rollup(pages, ["doc_id"]).collect()}
    assert got == {1: (True, 10, True, 1, 2), 2: (False, 0, False, 0, 0)}


def test_replies(spark):
    replies = [
        (1, '{"markdown": "m", "content_list": [{"page_idx": 1, "text": "b"}, {"page_idx": 0, "type": "title", "text": "Title", "bbox": [1, 2]}]}'),
        (2, '{"md": 5, "result": {"full_md": "whole", "content_list_v2": [[{"text": ""}], [{"text": "p"}, {"page_idx": 7, "text": "q"}]]}}'),
        (3, '{"md_content": "", "markdown": "only"}'), (4, "not json"),
    ]
    got = {(r.doc_id, r.page_number): (r.markdown_content, r.plain_text, [e.kind for e in r.elements]) for r in reply_pages(spark.createDataFrame(replies, "doc_id int, reply string"), ["doc_id"]).collect()}
    assert got == {
        (1, 1): ("Title", "Title", ["title"]), (1, 2): ("b", "b", ["text"]), (2, 1): ("whole", "", ["text"]), (2, 2): ("p", "p", ["text"]), (2, 8): ("q", "q", ["text"]),
        (3, 1): ("only", "", []), (4, 1): ("", "", []),
    }


def test_replies_at_any_depth(spark):
    def nested(inner, depth):
        for _ in range(depth):
            inner = {"result": inner, "md": "outer"}
        return json.dumps(inner)

    replies = [
        (1, nested({"content_list": [{"text": "deep"}]}, 9)), (2, nested({"content_list": [], "content_list_v2": [[{"text": "x"}], "no list", [{"text": "y"}]]}, 4)),
        (3, nested({"content_list": ["text", {"text": "not first"}], "content_list_v2": [{"text": "v2"}, 5, {"text": "w"}]}, 1)),
        (4, nested({"content_list": [[], []], "result": {"content_list": [{"text": "not reached"}]}}, 2)), (5, nested({"content_list": [{"text": "esc"}]}, 2).replace("result", "resul\\u0074")), (6, None), (7, '{"result": [1], "markdown": "m"}'),
    ]
    got = {}
    pages = reply_pages(spark.createDataFrame(replies, "doc_id int, reply string"), ["doc_id"])
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for r in pages.collect():
        got.setdefault(r.doc_id, {})[r.page_number] = (r.markdown_content, len(r.elements))
    assert got == {1: {1: ("deep", 1)}, 2: {1: ("x", 1), 3: ("y", 1)}, 3: {1: ("v2\nw", 2)}, 4: {1: ("outer", 0)}, 5: {1: ("esc", 1)}, 6: {1: ("", 0)}, 7: {1: ("m", 0)}}


def test_markers_around_and_within_whole_documents(spark):
    """marker_ranges' operators on whole texts, against Python's re: markers before, within and after every document."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text")
    k = F.pmod("doc_id", F.lit(6)).cast("int")
    parts = [page_marker(k + 3), F.expr("left(text, cast(length(text) / 2 as int))"), page_marker(k + 1), F.expr("substring(text, cast(length(text) / 2 as int) + 1)"), page_marker(k + 3), "text", F.lit("<!--page_number:  9-->")]
    docs = docs.select("doc_id", "text", F.concat(*parts).alias("content"))
    got = docs.select("doc_id", "text", marker_pages(F.col("content")).alias("markers"), without_markers(F.col("content")).alias("clean")).collect()
    pages = {}
    for r in chunk(docs.select("doc_id", "content"), ["doc_id"]).select("doc_id", "page_numbers").collect():
        pages.setdefault(r.doc_id, set()).update(r.page_numbers)
    assert len(got) > 100 and max(len(r.text) for r in got) > 10_000
    for r in got:
        n = r.doc_id % 6
        assert "<!--" not in r.text and r.markers == [n + 3, n + 1, n + 3, 9]
        assert r.clean == (r.text * 2).strip()
        assert pages[r.doc_id] >= {n + 3, n + 1, 9}


def test_lists_at_the_first_levels_are_found_by_compiled_code(spark):
    elements = [{"page_idx": (7 * k) % 5 - 1, "text": f"t{k}" if k % 3 else "", "type": "x" if k % 2 else None, "bbox": [k, 1]} for k in range(40)]
    reply = json.dumps({"md": "whole", "result": {"result": {"content_list": elements}}})
    pages = reply_pages(spark.createDataFrame([(1, reply), (2, '{"md": "whole"}'), (3, "no")], "doc_id int, reply string"), ["doc_id"])
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "$.result.content_list[0]" in plan
    got = {(r.doc_id, r.page_number): (r.markdown_content, r.plain_text, [(e.kind, e.text, e.bbox) for e in r.elements]) for r in pages.collect()}
    want = {(2, 1): ("whole", "", []), (3, 1): ("", "", [])}
    for p in range(-1, 4):
        own = [e for e in elements if e["page_idx"] == p]
        text = "\n".join(e["text"] for e in own if e["text"])
        want[1, p + 1] = (text, text, [(e["type"] or "text", e["text"], [float(x) for x in e["bbox"]]) for e in own])
    assert got == want
