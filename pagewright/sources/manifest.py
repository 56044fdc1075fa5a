"""Benchmark manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.quality import CHECKS

SAMPLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("engine", T.StringType()), T.StructField("checks", CHECKS),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample, its checks as a struct; keys that aren't known are left out."""
    payload = json.loads(spark.sparkContext.wholeTextFiles(path).values().first())
    samples = payload.get("samples") if isinstance(payload, dict) else None
    if not isinstance(samples, list):
        raise ValueError("A benchmark manifest is a JSON object that holds a samples list.")
    lines = [(json.dumps(s),) for s in samples]
    return spark.createDataFrame(lines, "j string").selectExpr(f"from_json(j, '{SAMPLE.simpleString()}') AS s").select("s.*")
