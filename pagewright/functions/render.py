"""Blocks, tables and pages as Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import page_marker, strip


def block(style: Column, text: Column) -> Column:
    """A paragraph by its style's name; null for an empty one."""
    s, t = F.lower(F.coalesce(style, F.lit(""))), strip(text)
    line = (
        F.when(s.contains("heading 1") | s.contains("title"), F.concat(F.lit("# "), t))
        .when(s.contains("heading 2"), F.concat(F.lit("## "), t))
        .when(s.contains("heading 3"), F.concat(F.lit("### "), t))
        .when(s.contains("list"), F.concat(F.lit("- "), t))
        .otherwise(t)
    )
    return F.when(F.length(t) > 0, line)


def cell(value: Column) -> Column:
    """A cell's text on one line; null is empty."""
    return F.replace(strip(F.coalesce(value.cast("string"), F.lit(""))), F.lit("\n"), F.lit(" "))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table(rows: Column) -> Column:
    """array<array<string>> as a pipe table, the first row being its head; null if there is no row."""
    clean = F.transform(rows, lambda r: F.transform(r, cell))
    rule = _row(F.transform(clean[0], lambda _: F.lit("---")))
    body = F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), _row)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(_row(clean[0]), rule), body), "\n"))


def page(text: Column, tables: Column) -> Column:
    """A page's text, then a blank line, then its tables (array<array<array<string>>>)."""
    full = F.filter(tables, lambda t: F.size(t) > 0)
    joined = F.array_join(F.transform(full, table), "\n")
    return F.when(F.size(full) > 0, strip(F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n"), joined))).otherwise(F.coalesce(text, F.lit("")))


def sheet(name: Column, markdown: Column) -> Column:
    return F.concat(F.lit("### Sheet: "), name, F.lit("\n\n"), markdown)


def marked_page(number: Column, markdown: Column) -> Column:
    """A page behind its marker; pages so marked are joined by a newline."""
    return F.concat(F.lit("\n"), page_marker(number), F.lit("\n\n"), F.coalesce(markdown, F.lit("")))
