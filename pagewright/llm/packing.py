"""Operator 5: hierarchical residual best-fit packing.

A text's size is its number of UTF-8 bytes (or a given size column, in tokens say). Texts larger than a bin
are cut into full bins and a rest. The rests are dealt to groups by hash; each group packs its own,
largest first, always into the fullest bin that still takes the item. Bins filled to `nearly` are
emitted; the others go on as items: each round merges `fan_in` groups into one and packs their
underfull bins again, until one group is left. Groups hold about `group_items` items; where as many groups as before would be
needed and hardly a bin was merged, the rest is emitted: no task ever gathers what can't be merged.

Only (number, size) moves; texts stay where they are, and the result names each piece by id,
start and size.

Defined cases: null and empty texts need no room and aren't listed; a null id is carried as it is; each of
several equal rows is packed; extra columns play no part; an id column of an added name keeps it, and the added one gets
an underscore; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, discard, finished, materialise

CAPACITY, NEARLY, GROUP_ITEMS, FAN_IN = 32_768, 0.98, 50_000, 8


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Each item's bin, items being packed largest first."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[int] = []  # the residuals that some bin has, ascending
    bins: dict[int, list[int]] = {}
    out = [0] * len(sizes)
    made = 0
    for i in order:
        size = sizes[i]
        at = bisect_left(room, size)
        if at < len(room):
            left = room[at]
            of = bins[left]
            b = of.pop()
            if not of:
                del bins[left]
                room.pop(at)
        else:
            left, b = capacity, made
            made += 1
        out[i] = b
        left -= size
        if left:
            if left in bins:
                bins[left].append(b)
            else:
                bins[left] = [b]
                insort(room, left)
    return out


def _packer(capacity: int, nearly: int, last: bool):
    return lambda table: _pack(table, capacity, nearly, last)


def _pack(table: pa.Table, capacity: int, nearly: int, last: bool) -> pa.Table:
    """One round in one group. In: grp, size, items (lists of numbers). Out: the bins, and whether they
    are finished."""
    sizes = table.column("size").to_pylist()
    order = np.argsort(np.array([x[0] for x in table.column("items").to_pylist()]), kind="stable")  # the order rows came in plays no part
    bins = np.array(best_fit([sizes[i] for i in order], capacity))
    lists = table.column("items").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    order = order[np.argsort(bins, kind="stable")]
    bins = np.sort(bins)
    n = int(bins[-1]) + 1
    total = np.bincount(bins, weights=np.array(sizes)[order], minlength=n).astype(np.int64)
    taken = lists.take(pa.array(order))
    per_item = np.array(taken.value_lengths())
    counts = np.bincount(bins, weights=per_item, minlength=n).astype(np.int64)
    items = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), taken.flatten())
    grp = np.full(n, table.column("grp")[0].as_py(), np.int64)
    return pa.table({"grp": grp, "size": total, "items": items, "done": (total >= nearly) | last})


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, capacity: int = CAPACITY,
    nearly: float = NEARLY, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN,
) -> DataFrame:
    """(bin_id, place, id, start, size): the pieces of every bin in their order."""
    spark = docs.sparkSession
    size = F.octet_length(col(text_col)) if size_col is None else col(size_col)
    source = docs.select(col(id_col).alias("id"), size.cast("long").alias("total")).where("total > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(capacity).cast("long"))
    pieces = source.select("id", "total", F.explode(starts).alias("start"))
    pieces = pieces.select("id", "start", F.least(F.col("total") - F.col("start"), F.lit(capacity)).alias("size"))
    pieces = pieces.withColumn("item", F.monotonically_increasing_id())
    pieces, p0 = materialise(pieces, "pack-pieces")  # written, so that the numbers stay
    bins = [pieces.where(F.col("size") == capacity).select(F.array("item").alias("items"))]
    now = pieces.where(F.col("size") < capacity).select("size", F.array("item").alias("items"))
    n = now.count()
    groups = max(1, -(-n // group_items))
    round_no, paths = 0, []
    least = int(np.ceil(capacity * nearly))
    while n:
        last = groups == 1
        grp = F.pmod(F.xxhash64(F.col("items")[0], F.lit(round_no)), F.lit(groups))
        packed = (
            now.withColumn("grp", grp).select("grp", "size", "items").groupBy("grp")
            .applyInArrow(_packer(capacity, least, last), "grp long, size long, items array<long>, done boolean")
        )
        packed, path = materialise(packed, "pack-bins")
        paths.append(path)
        bins.append(packed.where("done").select("items"))
        now = packed.where("not done").select("size", "items")
        m = now.count()
        fewer = max(-(-groups // fan_in), -(-m // group_items), 1)
        if m > 0.95 * n and fewer >= groups:  # merging doesn't help any more
            bins.append(now.select("items"))
            break
        n, groups = m, fewer
        round_no += 1
    all_bins = bins[0]
    for b in bins[1:]:
        all_bins = all_bins.unionByName(b)
    all_bins, _ = materialise(all_bins.withColumn("bin_id", F.monotonically_increasing_id()), "pack-all")
    discard(spark, paths)
    placed = all_bins.select("bin_id", F.posexplode("items").alias("place", "item"))
    name = lambda x: x + "_" * (x == id_col.lower())
    out = placed.join(pieces, "item")
    return out.select(*(F.col(x).alias(name(x)) for x in ("bin_id", "place")), F.col("id").alias(id_col), *(F.col(x).alias(name(x)) for x in ("start", "size")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 32 KiB."""
    return finished(spark, lambda: pack(spark.read.parquet(f"{sf_dir}/documents.parquet")), "packed")
