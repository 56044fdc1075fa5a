"""Text primitives as Catalyst expressions, with the white space and line rules of Unicode text.

Java's and Unicode's ideas of white space and line ends differ; these patterns spell them out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
MARKER = rf"<!--{WS}*page_number:{WS}*(\d+){WS}*-->"
HEADER = rf"(?md)^(#{{1,6}}){WS}+(.+)$"
HEADER_AT_START = rf"(?d)\A(#{{1,6}}){WS}+(.+)(?:\n|\z)"
TABLE_RULE = rf"\A{WS}*\|?{WS}*:?-{{3,}}:?{WS}*(\|{WS}*:?-{{3,}}:?{WS}*)+\|?{WS}*\z"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def without_markers(text: Column) -> Column:
    """Without page markers, and without white space at either end of what is left."""
    return strip(F.regexp_replace(text, MARKER, ""))


def marker_pages(text: Column) -> Column:
    """The page numbers of all markers, in their order. A number beyond 32 bits is null."""
    return F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda p: p.try_cast("int"))


def page_marker(number: Column) -> Column:
    return F.concat(F.lit("<!-- page_number: "), number.cast("string"), F.lit(" -->"))


def count_tables(text: Column) -> Column:
    """How many Markdown tables of two columns or more there are: their rules are counted."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: x.rlike(TABLE_RULE)))
