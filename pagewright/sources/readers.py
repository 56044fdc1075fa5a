"""The readers: files to pages, an error being a row and not the end of the job.

Python only turns bytes into text, blocks and cells; all Markdown is rendered by Catalyst. A row of what Python gives is a file with its pages, so
that no text is shuffled, neither for pages nor for documents, and each file is read and unpacked once, by an executor.
"""

from __future__ import annotations

import importlib
import io
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render as M
from ..functions import text as T
from ..operators.assemble import joined
from .files import locate, read_bytes
from .office import docx_blocks, xlsx_sheets

_TABLE = "array<array<string>>"
#: A page as the readers give it: text, cells of a sheet (with its name) or blocks.
_PART = f"struct<page_number:int,kind:string,text:string,name:string,rows:{_TABLE},tables:array<{_TABLE}>,blocks:array<struct<kind:string,style:string,text:string,rows:{_TABLE}>>>"
#: A file with its pages; one that can't be read has none.
_FILE = f"source string, filename string, extension string, parts array<{_PART}>, error_class string, error_message string, seconds double"
_BLANK = dict.fromkeys(("page_number", "kind", "text", "name", "rows", "tables", "blocks"))
_NAMES = ["source", "filename", "extension", "parts", "error_class", "error_message", "seconds"]
#: Files go back to Spark by so many bytes or files at a time.
_BYTES, _FILES = 4 << 20, 256


def cell_texts(values: list) -> list[str]:
    """A column's cells as a data frame would show them: numbers are whole only if the column has no gap and no fraction."""
    there = [v for v in values if v is not None]
    gap, number = len(there) < len(values), lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if there and all(map(number, there)):
        if not gap and all(isinstance(v, int) for v in there):
            return [str(v) for v in values]
        return ["nan" if v is None else f"{float(v):g}" for v in values]
    none = "NaT" if there and all(isinstance(v, datetime) for v in there) else "nan"
    return [none if v is None else str(v) for v in values]


def _text(raw: bytes) -> Iterator[dict]:
    yield {"kind": "text", "text": raw.decode("utf-8")}


def _docx(raw: bytes) -> Iterator[dict]:
    names = ("kind", "style", "text", "rows")
    yield {"kind": "docx", "blocks": [dict(zip(names, b)) for b in docx_blocks(raw)]}


def _frame(df: pd.DataFrame) -> list[list[str]]:
    columns = [cell_texts([None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in df[c]]) for c in df.columns]
    floats = [k for k, c in enumerate(df.columns) if df[c].dtype.kind == "f"]
    for k in floats:  # a column of fractions that happen to be whole
        columns[k] = ["nan" if pd.isna(v) else f"{v:g}" for v in df[df.columns[k]]]
    return [[str(c) for c in df.columns], *map(list, zip(*columns))]


def _excel(raw: bytes) -> Iterator[dict]:
    if raw[:4] == b"\xd0\xcf\x11\xe0":  # the older, binary kind
        try:
            importlib.import_module("xlrd")
        except ImportError as e:
            raise ImportError("xlrd is needed to read binary workbooks") from e
        sheets = {n: _frame(df) for n, df in pd.read_excel(io.BytesIO(raw), sheet_name=None).items()}
    else:
        sheets = {}
        for name, rows in xlsx_sheets(raw):
            head = [f"Unnamed: {k}" if c is None else str(c) for k, c in enumerate(rows[0])] if rows else []
            body = zip(*(cell_texts(list(c)) for c in zip(*rows[1:]))) if len(rows) > 1 else ()
            sheets[name] = [head, *map(list, body)] if rows else []
    for name, rows in sheets.items():
        yield {"kind": "sheet", "name": name, "rows": rows}


def _csv(raw: bytes) -> Iterator[dict]:
    yield {"kind": "csv", "rows": _frame(pd.read_csv(io.BytesIO(raw)))}


def simple_pdf(raw: bytes) -> Iterator[dict]:
    """Pages' text and tables by an optional library."""
    try:
        pdf = importlib.import_module("pdfplumber")
    except ImportError as e:
        raise ImportError("pdfplumber is needed to read PDF files") from e
    with pdf.open(io.BytesIO(raw)) as doc:
        for p in doc.pages:
            tables = [[["" if c is None else str(c) for c in row] for row in t] for t in (p.extract_tables() or []) if t]
            yield {"text": p.extract_text() or "", "tables": tables}


def _missing(name: str) -> Callable[[bytes], Iterator[dict]]:
    def run(raw: bytes) -> Iterator[dict]:
        raise NotImplementedError(f"PDF engine {name} is not implemented")

    return run


#: PDF engines by name: bytes to pages, each a dict of text and tables. The services behind the last four aren't part of this library.
ENGINES: dict[str, Callable[[bytes], Iterator[dict]]] = {"simple": simple_pdf} | {n: _missing(n) for n in ("mineru", "vision_llm", "deepdoc", "paddle")}


def register_engine(name: str, engine: Callable[[bytes], Iterator[dict]]) -> None:
    """Let read_pages take a PDF engine by name. What it gives is checked page by page: a page that is no dict, or has other keys than
    text and tables or values of other types, makes its file a failed row of class TypeError."""
    if not callable(engine):
        raise TypeError(f"PDF engine {name} is no callable")
    ENGINES[name] = engine


def _checked(name: str, pages: Iterator[dict]) -> Iterator[dict]:
    for k, page in enumerate(pages):
        if not isinstance(page, dict) or set(page) - {"text", "tables"} or not isinstance(page.get("text", ""), str):
            raise TypeError(f"page {k + 1} of PDF engine {name} must be a dict of text and tables")
        tables = page.get("tables") or []
        if not all(isinstance(t, (list, tuple)) and all(isinstance(r, (list, tuple)) for r in t) for t in tables):
            raise TypeError(f"the tables of page {k + 1} of PDF engine {name} must be lists of rows")
        yield {"kind": "page", "text": page.get("text", ""), "tables": [[["" if c is None else str(c) for c in r] for r in t] for t in tables]}


def _parts(files: DataFrame, engine: str) -> DataFrame:
    run_engine = ENGINES[engine]
    readers = {"text": _text, "docx": _docx, "excel": _excel, "csv": _csv, "pdf": lambda raw: _checked(engine, run_engine(raw))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for batch in batches:
            for source, full, filename, extension, family, raw in batch.itertuples(index=False):
                parts, error, began = [], (None, None), time.perf_counter()
                try:
                    if family is None:
                        raise ValueError(f"Unsupported file extension: {extension}")
                    raw = read_bytes(full) if raw is None else raw
                    held += len(raw)
                    parts = [_BLANK | part | {"page_number": k + 1} for k, part in enumerate(readers[family](raw))]
                except Exception as e:  # a file that can't be read is a failed row
                    parts, error = [], (type(e).__name__, str(e))
                if parts or error[0]:
                    out.append((source, filename, extension, parts, *error, time.perf_counter() - began))
                if held >= _BYTES or len(out) >= _FILES:
                    yield pd.DataFrame(out, columns=_NAMES)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return files.mapInPandas(run, _FILE)


def _markdown(part: Column) -> Column:
    block = lambda b: F.when(b["kind"] == "table", M.table(b["rows"])).when(b["kind"] == "paragraph", M.block(b["style"], b["text"]))
    blocks = F.filter(F.transform(part["blocks"], block), lambda x: x.isNotNull())
    kind = part["kind"]
    return (
        F.when(kind == "text", T.unify_newlines(part["text"]))
        .when(kind == "docx", F.array_join(F.transform(blocks, lambda x: F.concat(x, F.lit("\n"))), "\n"))
        .when(kind == "page", M.page(part["text"], part["tables"]))
        .when(kind == "csv", M.table(part["rows"]))
        .when(kind == "sheet", M.sheet(part["name"], F.coalesce(M.table(part["rows"]), F.lit(""))))
    )


def unpack(spark: SparkSession, paths: Iterable[str] | DataFrame, engine: str = "simple") -> DataFrame:
    """A row for each file: source, filename, extension, pages (page_number, markdown_content, plain_text, tables; in order), error_class,
    error_message and seconds. A path that is given twice is read once; what paths may be is said at locate."""
    if engine not in ENGINES:
        raise ValueError(f"Unknown PDF engine: {engine}. Available engines: {sorted(ENGINES)}")
    once = paths.select("source").distinct() if isinstance(paths, DataFrame) else dict.fromkeys(paths)
    plain = lambda p: F.when(p["kind"] == "page", p["text"]).otherwise(F.lit(""))
    page = lambda p: F.struct(p["page_number"].alias("page_number"), _markdown(p).alias("markdown_content"), plain(p).alias("plain_text"), p["tables"].alias("tables"))
    return _parts(locate(spark, once), engine).select("source", "filename", "extension", F.transform("parts", page).alias("pages"), "error_class", "error_message", "seconds")


def read_pages(spark: SparkSession, paths: Iterable[str] | DataFrame, engine: str = "simple") -> DataFrame:
    """source, filename, extension, page_number, markdown_content, plain_text, tables, error_class, error_message and seconds (what reading the
    file took) of every page of every file. A file that can't be read has one row without page. A path that is given twice is read once."""
    rows = unpack(spark, paths, engine).select("source", "filename", "extension", F.explode_outer("pages").alias("p"), "error_class", "error_message", "seconds")
    return rows.select("source", "filename", "extension", "p.page_number", "p.markdown_content", "p.plain_text", "p.tables", "error_class", "error_message", "seconds")


def _page(number: Column, markdown: Column, plain: Column, tables: Column, engine: str) -> Column:
    tables = F.transform(F.coalesce(tables, F.array().cast(f"array<{_TABLE}>")), lambda t: F.struct(t.alias("rows")))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    no_map = F.create_map().cast("map<string,string>")
    return F.struct(
        number.alias("page_number"), markdown.alias("markdown_content"), plain.alias("plain_text"), none("struct<kind:string,text:string,bbox:array<double>>").alias("elements"), tables.alias("tables"),
        none("map<string,string>").alias("images"), F.when(F.col("extension") == ".pdf", F.create_map(F.lit("engine_name"), F.lit(engine))).otherwise(no_map).alias("metadata"),
    )


def as_documents(pages: DataFrame, engine: str = "simple") -> DataFrame:
    """source, filename, extension, engine, content (Markdown; pages behind their markers but for plain text), markdown_content, pages (an
    array of structs) and the error of each file."""
    plain, ok = F.col("extension").isin(".md", ".txt"), F.max("error_class").isNull()
    number, markdown = F.col("page_number"), F.col("markdown_content")
    page = _page(number, markdown, F.col("plain_text"), F.col("tables"), engine)
    listed = F.transform(F.array_sort(F.collect_list(F.when(number.isNotNull(), F.struct(number.alias("o"), page.alias("p")))), lambda a, b: F.when(a["o"] < b["o"], -1).otherwise(1)), lambda r: r["p"])
    return pages.groupBy("source", "filename", "extension").agg(
        F.lit(engine).alias("engine"), F.when(ok, F.when(F.first(plain), F.first(markdown)).otherwise(joined(number, M.marked_page(number, markdown)))).alias("content"),
        F.when(ok, joined(number, markdown)).alias("markdown_content"), listed.alias("pages"), F.max("error_class").alias("error_class"), F.max("error_message").alias("error_message"),
    )


def joined_pages(pages: Column) -> Column:
    """The Markdown of a file's pages, which are in order."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p["markdown_content"], F.lit(""))), "\n")


def documents_of(files: DataFrame, engine: str = "simple") -> DataFrame:
    """What as_documents gives, of the rows that unpack gives: nothing moves."""
    plain, ok, pages = F.col("extension").isin(".md", ".txt"), F.col("error_class").isNull(), F.col("pages")
    marked = F.array_join(F.transform(pages, lambda p: M.marked_page(p["page_number"], p["markdown_content"])), "\n")
    listed = F.transform(pages, lambda p: _page(p["page_number"], p["markdown_content"], p["plain_text"], p["tables"], engine))
    return files.select(
        "source", "filename", "extension", F.lit(engine).alias("engine"), F.when(ok, F.when(plain, F.get(pages, 0)["markdown_content"]).otherwise(marked)).alias("content"),
        F.when(ok, joined_pages(pages)).alias("markdown_content"), listed.alias("pages"), "error_class", "error_message",
    )


def read_documents(spark: SparkSession, paths: Iterable[str] | DataFrame, engine: str = "simple") -> DataFrame:
    """Each file as as_documents gives it."""
    return documents_of(unpack(spark, paths, engine), engine)
