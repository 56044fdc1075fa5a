"""Files as rows, and which reader takes them."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

#: A task reads so many files at most; fewer where there are few, so that all cores have some.
FILES_A_TASK = 500


def flatten(inputs) -> list[str]:
    """Paths of arbitrarily nested lists, in their order."""
    if isinstance(inputs, (str, os.PathLike)):
        return [os.fspath(inputs)]
    return [p for item in inputs for p in flatten(item)]


def expand_inputs(inputs, sort: bool = False, suffix: str = ".pdf") -> list[str]:
    """Files of any type as they are, folders as their immediate files of the suffix in order of name. A missing path is
    an error. sort: the whole list in order, else as given. Nothing is taken out for being there twice."""
    out: list[str] = []
    for path in flatten(inputs):
        if not os.path.exists(path):
            raise FileNotFoundError(f"Input path does not exist: {path}")
        if os.path.isdir(path):
            inside = (os.path.join(path, n) for n in sorted(os.listdir(path)))
            out += [p for p in inside if os.path.isfile(p) and p.lower().endswith(suffix)]
        else:
            out.append(path)
    return sorted(out) if sort else out


def locate(spark: SparkSession, paths: Iterable[str] | DataFrame) -> DataFrame:
    """source, full (where its bytes are), filename, extension, family and content (null but for URIs) of each path, spread evenly by number. A
    table of paths (source) never comes to the driver; it must hold paths that all executors see, and what isn't there fails when it is
    read. A path of a list that isn't there is an error, and URIs in a list are read by Spark."""
    if isinstance(paths, DataFrame):
        table, n, uris = paths.select("source"), paths.count(), []
    else:
        listed = list(paths)
        uris = [p for p in listed if "://" in p]
        near = [p for p in listed if "://" not in p]
        for p in near:
            if not os.path.exists(p):
                raise FileNotFoundError(f"Input path does not exist: {p}")
        table, n = spark.createDataFrame([(p,) for p in near], "source string"), len(near)
    here = os.getcwd()
    full = F.when(F.col("source").startswith("/"), F.col("source")).otherwise(F.concat(F.lit(here.rstrip("/") + "/"), "source"))
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // FILES_A_TASK))))
    found = table.repartition(tasks, "source").select("source", full.alias("full"), F.lit(None).cast("binary").alias("content"))
    if uris:
        names = spark.createDataFrame([(u,) for u in uris], "source string")
        scanned = spark.read.format("binaryFile").load(sorted(set(uris))).select(F.col("path").alias("source"), "content")
        found = found.unionByName(F.broadcast(names).join(scanned, "source").withColumn("full", F.col("source")))
    source = F.col("source")
    return found.select("source", "full", P.name(source).alias("filename"), P.extension(source).alias("extension"), P.family(source).alias("family"), "content")


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def read_files(spark: SparkSession, paths: Iterable[str] | DataFrame) -> DataFrame:
    """source, filename, extension, family and content (binary) of each path. Bytes are read by the executors, file by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                content = read_bytes(row.full) if row.content is None else row.content
                yield pd.DataFrame([(row.source, row.filename, row.extension, row.family, content)], columns=["source", "filename", "extension", "family", "content"])

    return locate(spark, paths).mapInPandas(run, "source string, filename string, extension string, family string, content binary")
