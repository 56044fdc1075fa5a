"""Queries that write files from the driver's tables and read them back through the readers, batches and sinks.

The files go below the folder in spark.checkpoint.dir, which all executors share; only a session on one machine without
that setting gets a temporary folder.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.batch import run_batch
from ..sources import sinks
from ..sources.readers import as_documents, read_documents, read_pages

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, as a path."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagewright-")
    return f"{base.removeprefix('file://').rstrip('/')}/files-{uuid.uuid4().hex}"


def _write(files: DataFrame, folder: str) -> DataFrame:
    """name and content (text or binary) as files of a folder; their paths, as a table (source) beside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            os.makedirs(folder, exist_ok=True)
            for name, content in zip(b["name"], b["content"]):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(content.encode() if isinstance(content, str) else content)
            yield pd.DataFrame({"source": folder + "/" + b["name"]})

    names = f"file://{folder}-names"
    files.select("name", "content").mapInPandas(run, "source string").write.parquet(names)
    return files.sparkSession.read.schema("source string").parquet(names)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _id(column: str) -> Column:
    return F.regexp_extract(column, r"(\d+)\.[^.]*$", 1).cast("long")


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents as text and Markdown files, some of them with the line ends of other systems, read back."""
    docs = _t(spark, d, "documents").where("text is not null")
    text = F.when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 2, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".TXT"))
    paths = _write(docs.select(name.alias("name"), text.alias("content")), work_folder(spark))
    return read_documents(spark, paths).select(_id("filename").alias("doc_id"), "extension", "content", F.coalesce("error_class", F.lit("")).alias("error_class"))


def csv_files(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file of each nation's suppliers, with gaps and leading zeros, read back as tables."""
    cells = F.concat_ws(",", F.format_string("%05d", "s_suppkey"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise((F.col("s_suppkey") % 7).cast("string")), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("yes"))
    lines = F.array_join(F.concat(F.array(F.lit("key,name,rest,note")), F.array_sort(F.collect_list(cells))), "\n")
    files = _t(spark, d, "supplier").groupBy("s_nationkey").agg(lines.alias("content")).select(F.concat(F.lit("n-"), F.col("s_nationkey"), F.lit(".csv")).alias("name"), "content")
    pages = read_pages(spark, _write(files, work_folder(spark)))
    return pages.select(_id("filename").alias("nation"), F.col("page_number").cast("long").alias("page_number"), "markdown_content")


def workbook(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A workbook of sheets, with whatever strings and numbers their cells have."""
    out = io.BytesIO()
    cell = lambda v: "" if v is None else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {_S} xmlns:r="{_R}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, (_, rows) in enumerate(sheets):
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {_S}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def workbooks(spark: SparkSession, d: str) -> DataFrame:
    """A workbook of each brand's parts, a sheet for each size, read back as pages."""
    part = _t(spark, d, "part").select("p_brand", "p_size", "p_partkey", "p_name", (F.col("p_partkey") % 10 + 0.25).alias("price"))
    rows = part.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "price"))).alias("rows"))
    books = rows.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_size", "rows"))).alias("sheets"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [workbook([(f"size {s['p_size']}", [["key", "name", "price"], *([r["p_partkey"], r["p_name"], r["price"]] for r in s["rows"])]) for s in x]) for x in b["sheets"]]
            yield pd.DataFrame({"name": b["p_brand"].str.replace("#", "-") + ".xlsx", "content": made})

    pages = read_pages(spark, _write(books.mapInPandas(pack, "name string, content binary"), work_folder(spark)))
    return pages.select(_id("filename").alias("brand"), F.col("page_number").cast("long").alias("page_number"), "markdown_content")


def word_document(blocks: list[tuple[str, str]], table: list[list[str]]) -> bytes:
    """A document of paragraphs (style and text) and one table after them."""
    out = io.BytesIO()
    paragraph = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'
    cells = lambda row: "".join(f"<w:tc>{paragraph('N', c)}</w:tc>" for c in row)
    body = "".join(paragraph(s, t) for s, t in blocks) + "<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in table) + "</w:tbl>"
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{n}"/></w:style>' for k, n in (("H1", "heading 1"), ("H2", "heading 2"), ("L", "List Bullet"), ("N", "Normal")))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f"<w:styles {_W}>{styles}</w:styles>")
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def word_files(spark: SparkSession, d: str) -> DataFrame:
    """A word-processor file of each nation: its name, its segments as a list, and its customers' numbers as a table; read back."""
    customer = _t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    listed = customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", F.col("n").cast("string").alias("n")))).alias("segments"))
    docs = _t(spark, d, "nation").join(listed, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "n_name", "segments")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for name, segments in zip(b["n_name"], b["segments"]):
                blocks = [("H1", name), ("N", "  "), *(("L", s["c_mktsegment"]) for s in segments), ("N", f" All of {name} ")]
                made.append(word_document(blocks, [["Segment", "Customers"], *([s["c_mktsegment"], s["n"]] for s in segments)]))
            yield pd.DataFrame({"name": "nation-" + b["n_nationkey"].astype(str) + ".docx", "content": made})

    paths = _write(docs.mapInPandas(pack, "name string, content binary"), work_folder(spark))
    return read_documents(spark, paths).select(_id("filename").alias("nation"), "content")


def batch_files(spark: SparkSession, d: str) -> DataFrame:
    """A batch over all documents as files, every fifth of a kind that can't be read, the outputs of the labelled ones being there."""
    folder = work_folder(spark)
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.when(F.col("doc_id") % 5 == 0, ".html").otherwise(".md"))
    paths = _write(_t(spark, d, "documents").where("text is not null").select(name.alias("name"), F.col("text").alias("content")), f"{folder}/in")
    _write(_t(spark, d, "labels").select(F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("name"), F.lit("there").alias("content")), f"{folder}/out")
    items, _ = run_batch(spark, paths, f"{folder}/out", skip_existing=True)
    output = F.regexp_extract("output_path", "([^/]*)$", 1)
    measures = (F.coalesce(F.col(f"metrics.{m}").cast("long"), F.lit(0)).alias(n) for m, n in (("page_count", "pages"), ("markdown_chars", "markdown_chars"), ("output_bytes", "output_bytes")))
    return items.select(_id("source").alias("doc_id"), "status", F.coalesce("error_type", F.lit("")).alias("error_type"), F.coalesce(output, F.lit("")).alias("output"), *measures)


def output_names(spark: SparkSession, d: str) -> DataFrame:
    """Where the outputs of a batch go whose files share their names by twos or threes."""
    docs = [r.doc_id for r in _t(spark, d, "documents").select("doc_id").orderBy("doc_id").collect()]  # each name depends on all before
    paths = [f"/in/{i % 10}/{i % 3}/doc-{i // 3}.pdf" for i in docs]
    return spark.createDataFrame(list(zip(docs, P.distinct_outputs(paths, "json"))), "doc_id long, output string")


def json_output(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON documents with their pages, and what a reader of that JSON finds."""
    c = _t(spark, d, "conversations")
    no_tables = F.when(F.col("turn") == 0, F.array(F.array(F.array(F.lit("a"), F.lit("b"))))).cast("array<array<array<string>>>")
    none = F.lit(None).cast("string")
    pages = c.select(
        F.concat(F.lit("/in/"), "conv_id", F.lit(".pdf")).alias("source"), F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit(".pdf").alias("extension"),
        (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("markdown_content"), F.col("role").alias("plain_text"), no_tables.alias("tables"), none.alias("error_class"), none.alias("error_message"),
    )
    page = "struct<page_number:int,markdown_content:string,plain_text:string,elements:array<string>,tables:array<struct<rows:array<array<string>>>>,metadata:map<string,string>>"
    kind = f"struct<source:string,filename:string,engine:string,pages:array<{page}>,markdown_content:string,metadata:map<string,string>>"
    read = sinks.rendered(as_documents(pages, "simple"), "json").select(F.from_json("output", kind).alias("j"))
    return read.select(
        _id("j.source").alias("conv_id"), "j.filename", "j.engine", F.size("j.pages").cast("long").alias("n_pages"), F.array_join(F.transform("j.pages", lambda p: p["plain_text"]), ",").alias("roles"),
        F.coalesce(F.expr("j.pages[0].tables[0].rows[0][1]"), F.lit("")).alias("first_cell"), F.expr("size(j.pages[0].elements)").cast("long").alias("n_elements"), F.expr("j.pages[0].metadata['engine_name']").alias("of_engine"),
        "j.markdown_content", F.size("j.metadata").cast("long").alias("n_metadata"),
    )


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents' rows with gaps as JSON lines, and each line as text."""
    path = work_folder(spark)
    rows = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("n"), F.lit("é漢").alias("t")).alias("more"))
    sinks.write_jsonl(rows, "file://" + path)
    lines = spark.read.text("file://" + path)
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("line"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "text_files": text_files,
    "csv_files": csv_files,
    "workbooks": workbooks,
    "word_files": word_files,
    "batch_files": batch_files,
    "output_names": output_names,
    "json_output": json_output,
    "json_lines": json_lines,
}

SQL: dict[str, str] = {
    "text_files": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS extension, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content, '' AS error_class FROM documents WHERE text IS NOT NULL",
    "csv_files": r"""WITH g AS (SELECT s_nationkey, bool_or(s_suppkey % 3 = 0) AS gap FROM supplier GROUP BY ALL)
SELECT s_nationkey::bigint AS nation, 1::bigint AS page_number,
       '| key | name | rest | note |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' | '
       || CASE WHEN s_suppkey % 3 = 0 THEN 'nan' ELSE (s_suppkey % 7)::varchar END || ' | ' || CASE WHEN s_suppkey % 4 = 0 THEN 'nan' ELSE 'yes' END || ' |', chr(10) ORDER BY s_suppkey) AS markdown_content
FROM supplier JOIN g USING (s_nationkey) GROUP BY s_nationkey""",
    "workbooks": r"""WITH s AS (
  SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS page_number,
         '### Sheet: size ' || p_size || chr(10) || chr(10) || '| key | name | price |' || chr(10) || '| --- | --- | --- |' || chr(10)
         || string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || (p_partkey % 10) || '.25 |', chr(10) ORDER BY p_partkey) AS markdown_content
  FROM part GROUP BY p_brand, p_size
)
SELECT replace(p_brand, 'Brand#', '')::bigint AS brand, page_number, markdown_content FROM s""",
    "word_files": r"""WITH c AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL)
SELECT n_nationkey::bigint AS nation, chr(10) || '<!-- page_number: 1 -->' || chr(10) || chr(10) || '# ' || n_name || chr(10) || chr(10) || string_agg('- ' || s || chr(10), chr(10) ORDER BY s) || chr(10)
       || 'All of ' || n_name || chr(10) || chr(10) || '| Segment | Customers |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s || ' | ' || n || ' |', chr(10) ORDER BY s) || chr(10) AS content
FROM nation JOIN c ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""",
    "batch_files": r"""WITH d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t, doc_id IN (SELECT doc_id FROM labels) AS there FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN there THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN NOT there AND doc_id % 5 = 0 THEN 'unsupported_format' ELSE '' END AS error_type, CASE WHEN there OR doc_id % 5 <> 0 THEN 'doc-' || doc_id || '.md' ELSE '' END AS output,
       CASE WHEN NOT there AND doc_id % 5 <> 0 THEN 1 ELSE 0 END::bigint AS pages, CASE WHEN NOT there AND doc_id % 5 <> 0 THEN length(t) ELSE 0 END AS markdown_chars, CASE WHEN NOT there AND doc_id % 5 <> 0 THEN strlen(t) ELSE 0 END AS output_bytes
FROM d""",
    "output_names": r"""WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS k FROM documents)
SELECT doc_id, CASE k WHEN 1 THEN '' ELSE (doc_id % 3) || '/' END || 'doc-' || (doc_id // 3) || '.json' AS output FROM n""",
    "json_output": r"""
SELECT conv_id, conv_id || '.pdf' AS filename, 'simple' AS engine, count(*) AS n_pages, string_agg(role, ',' ORDER BY turn) AS roles, CASE WHEN min(turn) = 0 THEN 'b' ELSE '' END AS first_cell, 0::bigint AS n_elements,
       'simple' AS of_engine, string_agg(text, chr(10) ORDER BY turn) AS markdown_content, 0::bigint AS n_metadata
FROM conversations GROUP BY conv_id""",
    "json_lines": r"""
SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":' || CASE WHEN doc_id % 3 <> 0 THEN '"' || lang || '"' ELSE 'null' END || ',"more":{"n":' || CASE WHEN doc_id % 2 = 0 THEN n_chars::varchar ELSE 'null' END || ',"t":"é漢"}}' AS line FROM documents""",
}
