"""Batch and benchmark runs: many files to outputs, item rows and summaries."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.errors import classify
from ..sources import sinks
from ..sources.files import expand_inputs
from ..sources.manifest import read_manifest
from ..sources.readers import documents_of, joined_pages, unpack
from .metrics import measures
from .quality import quality_checks
from .summary import batch_summary, benchmark_summary

ITEM_COLUMNS = ("source", "status", "output_path", "metrics", "error_type", "error_message", "engine", "started_at", "finished_at")


def with_todo(listed: DataFrame, there: DataFrame) -> DataFrame:
    """listed (name, ...) with todo: whether the output of that name is still to be made, as it isn't among those that are there."""
    known = there.select("name", F.lit(True).alias("_there")).distinct()
    return listed.join(known, "name", "left").withColumn("todo", F.col("_there").isNull()).drop("_there")


def run_batch(
    spark: SparkSession, inputs, output_dir: str, engine: str = "simple", fmt: str = "markdown", collect_metrics: bool = True, *, fail_fast: bool = False, skip_existing: bool = False,
) -> tuple[DataFrame, dict]:
    """Items in order of source, and the summary; both are also written to output_dir. Each file's output is named by its
    stem, so that equal stems overwrite each other. A file that can't be read or written is a failed item, or with
    fail_fast an error. A file's seconds are those of its own reading, and a share of what the batch spends on all of them together. Output
    files that exist are skipped.

    inputs may be a table of paths (source) that all executors see, instead of lists: it never comes to the driver, must hold files only, and
    one that isn't there is a failed item.

    Every file is unpacked once, to a table of files with their pages below output_dir from which outputs, failures and metrics come; it is deleted at
    the end. The items that are returned are read from what was written. Names and measures move, texts don't."""
    listed = inputs.select("source") if isinstance(inputs, DataFrame) else spark.createDataFrame([(s,) for s in expand_inputs(inputs, sort=True)], "source string")
    os.makedirs(output_dir, exist_ok=True)
    began, started = time.perf_counter(), datetime.now(UTC).isoformat()
    base = "file://" + os.path.abspath(output_dir)
    work = f"{base}/.batch-{uuid.uuid4().hex}"
    try:
        listed = listed.withColumn("name", P.output_name(F.col("source"), fmt))
        state = _kept(_with_existing(listed, output_dir) if skip_existing else listed.withColumn("todo", F.lit(True)), f"{work}/state")  # before anything is written
        files = _kept(unpack(spark, state.where("todo").select("source"), engine), f"{work}/files")
        docs = sinks.rendered(documents_of(files, engine), fmt).withColumn("name", P.output_name(F.col("source"), fmt))
        written = sinks.write_documents(docs.where("error_class is null").select("source", "name", "output"), output_dir, "name", keep="source")
        failures = _kept(docs.where("error_class is not null").select("source", "error_class", "error_message").unionByName(
            written.where("error_class is not null").select("source", "error_class", "error_message")), f"{work}/failures")
        first = failures.orderBy("source").first() if fail_fast else None
        if first:
            raise RuntimeError(f"{first.source}: {first.error_class}: {first.error_message}")
        own, n = files.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)), F.count("*")).first()
        share = max(time.perf_counter() - began - own / spark.sparkContext.defaultParallelism, 0.0) / max(n, 1)
        measured = measures(_unmeasured(files.where("error_class is null"), share), ["source"])
        metrics = measured.select("source", F.struct(*(c for c in measured.columns if c != "source")).alias("metrics"))
        finished = datetime.now(UTC).isoformat()
        state = state.join(failures, "source", "left").join(metrics, "source", "left")
        status = F.when(~F.col("todo"), "skipped").when(F.col("error_class").isNotNull(), "failed").otherwise("success")
        ok = status == "success"
        items = state.select(
            "source", status.alias("status"), F.when(status != "failed", F.concat(F.lit(output_dir.rstrip("/") + "/"), "name")).alias("output_path"),
            F.when(ok & F.lit(collect_metrics), F.col("metrics")).alias("metrics"), F.when(status == "failed", classify(F.col("error_class"), F.col("error_message"))).alias("error_type"),
            "error_message", F.lit(engine).alias("engine"), F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"),
        ).orderBy("source")
        sinks.write_jsonl(items, f"{base}/batch-results.jsonl")
        items = spark.read.schema(items.schema).json(f"{base}/batch-results.jsonl").orderBy("source")
    finally:
        shutil.rmtree(work.removeprefix("file://"), ignore_errors=True)
    summary = batch_summary(items.select("source", "status", "metrics.page_count", "metrics.elapsed_seconds")).first().asDict(True)
    sinks.write_json(summary, os.path.join(output_dir, "batch-summary.json"))
    return items, summary


def _with_existing(listed: DataFrame, folder: str) -> DataFrame:
    """listed (source, name) with todo: whether the folder has nothing of that name. The executors look."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(todo=[not os.path.lexists(os.path.join(folder, n)) for n in b["name"]])

    folder = os.path.abspath(folder)
    return listed.select("source", "name").mapInPandas(run, "source string, name string, todo boolean")


def _unmeasured(files: DataFrame, share: float) -> DataFrame:
    """What document_metrics gathers of pages, of rows that hold all pages of a file."""
    tables = F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + F.when(p["tables"].isNotNull(), F.size(p["tables"])).otherwise(0))
    none = (F.lit(0).cast("long").alias(c) for c in ("image_count", "caption_count", "ocr_text_chars", "reading_order_warnings", "header_footer_removed_count"))
    return files.select(
        "source", (F.col("seconds") + share).alias("elapsed_seconds"), F.size("pages").alias("page_count"), joined_pages(F.col("pages")).alias("_md"), tables.alias("_tables"),
        F.lit(False).alias("ocr_applied"), F.lit(False).alias("multi_column_detected"), *none,
    )


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_benchmark(spark: SparkSession, manifest: str, output_dir: str = "reports", engine: str | None = None, fmt: str = "json") -> tuple[DataFrame, dict]:
    """Each sample's status, metrics and checks, and the summary; both are also written to output_dir. All samples of an
    engine run as one batch; samples that share an output name share the file."""
    samples = read_manifest(spark, manifest)
    chosen = F.lit(engine) if engine else F.coalesce("engine", F.lit("simple"))
    samples = samples.withColumn("engine", chosen)
    rows = None
    for name in [r.engine for r in samples.select("engine").distinct().collect()]:
        mine = samples.where(F.col("engine") == name)
        items, _ = run_batch(spark, sorted({r.path for r in mine.select("path").collect()}), os.path.join(output_dir, "outputs"), name, fmt)
        part = mine.join(items.drop("engine"), mine["path"] == items["source"]).select("id", "source", "category", "features", "status", "engine", "metrics", "error_type", "error_message", "checks")
        rows = part if rows is None else rows.unionByName(part)
    flat = quality_checks(rows.select("*", "metrics.*", "checks.*"))
    has = F.col("metrics").isNotNull()
    results = flat.select(
        "id", "source", "category", "features", "status", "engine", "metrics", "error_type", "error_message", F.when(has, F.struct("passed", "failures", "warnings")).alias("quality")
    )
    summary = benchmark_summary(results.select("id", "status", "quality.passed", "metrics.*")).first().asDict(True)
    sinks.write_jsonl(results, "file://" + os.path.abspath(os.path.join(output_dir, "benchmark-results.jsonl")))
    sinks.write_json(summary, os.path.join(output_dir, "benchmark-summary.json"))
    return results, summary
