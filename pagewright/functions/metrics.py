"""Scalar measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(pages: Column, seconds: Column) -> Column:
    """Pages a second to four places; 0 without time."""
    return F.when(seconds > 0, F.bround(pages / seconds, 4)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to four places; 0 where there is no whole."""
    return F.when(whole > 0, F.bround(part / whole, 4)).otherwise(F.lit(0.0))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def characters(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")
