"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge but the roots themselves, root being the least node of the
    component.

    edges: (u, v) of any orderable type without nulls. Each round writes its edges to the shared
    folder; a hub's neighbours are joined and aggregated, never gathered into one row.
    """
    spark = edges.sparkSession
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now, path = materialise(edges.where("u <> v").select(high, low).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after, written = materialise(small.select(high, low).distinct(), "edges")
        new = _state(after)
        discard(spark, [path])
        now, path = after, written
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
