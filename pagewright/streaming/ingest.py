"""Incremental ingest: new text files of a folder to chunks, each file once.

The stream's checkpoint does what skipping existing outputs does for a batch. Chunking is per document, hence
without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths as P
from ..functions.text import unify_newlines
from ..operators.chunk import chunk


def text_stream(spark: SparkSession, folder: str, pattern: str = "*.[mMtT][dDxX]*") -> DataFrame:
    """source and content of the folder's Markdown and text files that are valid UTF-8, as a stream."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    files = files.where((P.family(F.col("path")) == "text") & F.is_valid_utf8(F.col("content").cast("string")))
    return files.select(F.col("path").alias("source"), unify_newlines(F.decode("content", "UTF-8")).alias("content"))


def ingest_chunks(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunk what is new in the folder and append it to the Parquet table at target; the query ends when all is done. A
    batch that is run again after a failure overwrites what it had written."""

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch, ["source"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return text_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
