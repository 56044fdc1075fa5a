"""A corpus from documents to packed sequences, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the
columns of documents. No stage has SQL: two are trained, and the others follow them.

Defined cases: a null text is neither toxic nor a copy, so it stays unless the ranking rejects texts without letters, and needs no room in a
bin; an empty text likewise, but that of several empty texts one stays; null ids are carried through, and come last where one of several copies is
kept; of rows that repeat id and text one stays; long texts are judged whole and cut only into bins; extra columns stay until the last stage;
without labels nothing is rejected; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import packing, quality, radix, simhash, toxicity
from pagewright.llm.common import discard, finished_at


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentences stays under the threshold."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ranking score reaches the threshold."""
    return quality.filter_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return radix.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins of 32 KiB."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents, as all stages in turn leave them. What a stage leaves behind is deleted when the
    next one has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = finished_at(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            discard(spark, [last])
        last = path
    return docs
