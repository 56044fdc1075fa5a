"""Sinks: a file for each document, JSON lines, one JSON object, standard output."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_NESTED = ("source", "filename", "engine", "pages", "markdown_content")


def rendered(docs: DataFrame, fmt: str = "markdown") -> DataFrame:
    """Adds output: the document's Markdown, or as JSON the document with its pages, their tables and elements, and metadata."""
    if fmt == "markdown":
        return docs.withColumn("output", F.coalesce("markdown_content", F.lit("")))
    if fmt == "json":
        return docs.withColumn("output", F.to_json(F.struct(*(c for c in _NESTED if c in docs.columns), F.create_map().cast("map<string,string>").alias("metadata")), {"pretty": "true", "ignoreNullFields": "false"}))
    raise ValueError("Unsupported output format: " + fmt)


def write_documents(docs: DataFrame, folder: str, name: str = "output_path", text: str = "output", keep: str | None = None) -> DataFrame:
    """Write each row's text as UTF-8 to its path below a folder that all executors share; returns (path, error_class,
    error_message), and first the string column that is to be kept. The rows are written when the result is evaluated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for b in batches:
            rows = []
            for n, t, k in zip(b["name"], b["text"], b["kept"]):
                path, failed = os.path.join(folder, n), (None, None)
                try:
                    if (parent := os.path.dirname(path)) not in made:
                        os.makedirs(parent, exist_ok=True)
                        made.add(parent)
                    with open(path, "w", encoding="utf-8", newline="") as f:
                        f.write(t)
                except OSError as e:
                    failed = (type(e).__name__, str(e))
                rows.append((k, n, *failed))
            yield pd.DataFrame(rows, columns=["kept", "name", "error_class", "error_message"])

    kept = F.col(keep) if keep else F.lit(None).cast("string")
    written = docs.select(F.col(name).alias("name"), F.col(text).alias("text"), kept.alias("kept")).mapInPandas(run, "kept string, name string, error_class string, error_message string")
    return written.select(*([F.col("kept").alias(keep)] if keep else []), F.col("name").alias(name), "error_class", "error_message")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept, as a folder of part files."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(row: dict, path: str) -> None:
    """One object, pretty."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, ensure_ascii=False, indent=2, default=str)
