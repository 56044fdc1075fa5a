"""Operator 8: sharding along a Hilbert curve.

Each metadata dimension is quantised to 2^bits levels of about equal numbers of rows, by quantiles over all rows;
strings are cut by their whole values, whose rows are counted in ranges of the sorted distinct values. The cell's place on the Hilbert curve comes from a
table of the cells that hold rows, which is sent to the executors with each cell's shard. It has 2^20 rows at most: with more
dimensions than `bits` allow for that, each gets fewer bits (four get 5, five get 4, up to twenty). Runs of cells are cut into shards of about `shard_bytes`; a cell that is larger alone is
dealt to several shards by a hash of the id. The rows of a shard are written together, in the order of the
curve: a file then spans little of every dimension, which its minima and maxima tell a reader.

Defined cases: a null dimension counts as the least value; null and empty texts have no bytes, but one for the
row; ties share a cell; repeated rows share a shard; if the table has a column of a name that is
added, the added one gets underscores at its end until it has none; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, unused, value_cuts

BITS, SHARD_BYTES, MOST_BITS = 5, 64 << 20, 20


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of coordinates (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _is_text(docs: DataFrame, name: str) -> bool:
    return isinstance(docs.schema[name].dataType, (T.StringType, T.BinaryType))


def _value(docs: DataFrame, name: str) -> Column:
    """A dimension as what is compared: bytes, or a double in the same order."""
    if _is_text(docs, name):
        return col(name).cast("binary")
    if isinstance(docs.schema[name].dataType, T.DateType):
        return F.unix_date(col(name)).cast("double")
    return col(name).cast("double")


def shard(
    docs: DataFrame, dimensions: list[str], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """docs with hilbert and shard_id, each shard's rows together and in the order of the curve."""
    if not 0 < len(dimensions) <= MOST_BITS or not 0 < bits <= 10:
        raise ValueError(f"there must be from 1 to {MOST_BITS} dimensions, of 1 to 10 bits each")
    spark, bits = docs.sparkSession, min(bits, MOST_BITS // len(dimensions))
    levels = 1 << bits
    asked = [k / levels for k in range(1, levels)]
    quantiles = [F.percentile_approx(_value(docs, d), asked, 10_000).alias(f"d{i}") for i, d in enumerate(dimensions) if not _is_text(docs, d)]
    found = docs.agg(*quantiles).first().asDict() if quantiles else {}
    cuts = [[bytes(v) for v in value_cuts(docs, _value(docs, d), levels)] if _is_text(docs, d) else found[f"d{i}"] for i, d in enumerate(dimensions)]
    key, size = fresh(docs.columns, "cell"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + 1
    cell = F.lit(0)
    for d, c in zip(dimensions, cuts):
        v = _value(docs, d)
        level = F.lit(0)
        for k in sorted(set(c or [])):
            level = level + F.when(v > k, 1).otherwise(0)
        cell = cell * levels + level
    tagged = docs.withColumn(key, cell.cast("int"))
    rows = tagged.groupBy(key).agg(F.sum(size).alias("b")).collect()  # one for each cell that holds rows
    cells = np.array([r[key] for r in rows], np.int64)
    place = hilbert_index(np.stack([cells >> bits * k & levels - 1 for k in range(len(dimensions) - 1, -1, -1)], 1), bits)
    order = np.argsort(place)
    first, parts = np.zeros((2, len(cells)), np.int64)
    first[order], parts[order] = _runs(np.array([r["b"] for r in rows], float)[order], shard_bytes)
    c, h, f, n = (fresh(docs.columns, x) for x in ("of", "place", "first", "parts"))
    table = pd.DataFrame({c: cells.astype(np.int32), h: place, f: first, n: parts})
    taken = {x.lower() for x in docs.columns}
    names = [unused(x, taken) for x in ("hilbert", "shard_id")]
    places = F.broadcast(spark.createDataFrame(table, f"{c} int, {h} long, {f} long, {n} long"))
    within = F.pmod(F.xxhash64(col(id_col)), F.col(n))
    out = tagged.join(places, F.col(key) == F.col(c)).select(*(col(x) for x in docs.columns), F.col(h).alias(names[0]), (F.col(f) + within).alias(names[1]))
    # a task for each shard: hashing the number would bring some together
    return out.repartitionById(int((first + parts).max(initial=1)), F.col(names[1]).cast("int")).sortWithinPartitions(names[1], names[0], col(id_col))


def _runs(weight: np.ndarray, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells in the order of the curve: their first shard, and over how many they are dealt."""
    first, parts = np.zeros(len(weight), np.int64), np.ones(len(weight), np.int64)
    shard, filled = 0, 0.0
    for i, w in enumerate(weight.tolist()):
        if w >= shard_bytes:
            shard += filled > 0
            first[i], parts[i] = shard, -(-int(w) // shard_bytes)
            shard += int(parts[i])
            filled = 0.0
            continue
        if filled and filled + w > shard_bytes:
            shard, filled = shard + 1, 0.0
        first[i] = shard
        filled += w
    return first, parts


def manifest(sharded: DataFrame, dimensions: list[str], shard_col: str = "shard_id") -> DataFrame:
    """What a reader prunes by: rows, and each dimension's least and greatest value, of every shard."""
    bounds = [f(col(d)).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy(col(shard_col).alias("shard_id")).agg(F.count("*").alias("n_rows"), *bounds)


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards by source, language and length."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["source", "lang", "n_chars"])
