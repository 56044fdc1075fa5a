"""Operator 3: exact dedup by distributed most-significant-digit radix partitioning.

A level's digit is the next window of bytes. All rows of a group that agree in the window go on as
one group, those that stand alone are finished, and rows whose text ended within the window are equal
to each other. Windows grow eightfold from level to level, so that a long text needs few levels. No
digest decides anything: groups are split by the bytes themselves.

A level counts windows first, added up where the rows lie; then the rows meet the shared windows in one
hash join, whose skewed partitions can be split, and are written to the shared folder with what they met. Before the first level's join, a
bitmap of fixed size (16 MB, sent to all executors) with a bit for each shared window leaves out most rows that stand alone, so that their texts
never move. It proves nothing: the more windows are shared, the fewer it leaves out, and from some 10^8 shared windows on every text
moves once.

Defined cases: rows with a null text are kept; empty texts are equal to each other; among equal texts
the least id is kept, null ids come last, and of rows equal in text and id any one stays; extra columns
play no part and are kept; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, finished, fresh, materialise, projected

FIRST_WINDOW, GROWTH, FILTER_BITS = 256, 8, 1 << 27
_PAGE = 32_768  # bits of one bitmap


def _maybe_shared(rows: DataFrame, digit: str, shared: DataFrame, flag: str) -> DataFrame:
    """Marks rows whose window may be among the shared ones, by a bit for each of them in a filter of fixed size. A row that
    isn't marked needs no join; one that is marked has yet to prove it."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    page, place, bits = f"{flag}p", F.pmod(bit(F.col(digit)), F.lit(_PAGE)).cast("int"), f"{flag}b"
    pages = shared.select(bit(F.col("d0")).alias("b")).groupBy(F.expr(f"b div {_PAGE}").alias(page)).agg(F.bitmap_construct_agg(F.expr(f"b % {_PAGE}")).alias(bits))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.expr("1") + F.shiftright(place, 3), F.lit(1))), 16, 10).cast("int")
    tagged = rows.withColumn(page, (bit(F.col(digit)) / _PAGE).cast("long")).join(F.broadcast(pages), page, "left")
    return tagged.withColumn(flag, F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))).drop(page, bits)


def _levels(rows: DataFrame, text: Column, group: str, digit: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The rows that are alone in their text, and those that aren't with their group's number; each as the
    tables of the levels."""
    raw = text.cast("binary")
    alone: list[DataFrame] = [rows.where(text.isNull()).drop(group)]
    equal: list[DataFrame] = []
    now = rows.where(text.isNotNull()).withColumn(group, F.lit(0).cast("long"))
    g0, d0, g1 = f"{group}_0", f"{digit}_0", f"{group}_1"
    at, window = 1, FIRST_WINDOW
    while True:
        here = now.withColumn(digit, F.substring(raw, F.lit(at), F.lit(window)))
        shared = here.groupBy(group, digit).agg(F.count("*").alias("n")).where("n > 1")
        shared = shared.select(F.col(group).alias(g0), F.col(digit).alias(d0), F.monotonically_increasing_id().alias(g1))
        shared, _ = materialise(shared, "radix-shared")  # written, so that the numbers stay
        if shared.isEmpty():
            alone.append(here.drop(group, digit))
            return alone, equal
        if at == 1:  # most rows of the whole table stand alone: they stay where they are
            here = _maybe_shared(here, digit, shared.select(F.col(d0).alias("d0")), digit + "f")
            alone.append(here.where(~F.col(digit + "f")).drop(group, digit, digit + "f"))
            here = here.where(F.col(digit + "f")).drop(digit + "f")
        met = here.join(shared.hint("shuffle_hash"), (here[group] == shared[g0]) & (here[digit] == shared[d0]), "left")
        met = met.drop(group, g0, d0).withColumnRenamed(g1, group).withColumn(digit, F.length(digit) < window)
        met, _ = materialise(met, "radix-rows")
        alone.append(met.where(F.col(group).isNull()).drop(group, digit))
        met = met.where(F.col(group).isNotNull())
        equal.append(met.where(F.col(digit)).drop(digit))
        now = met.where(~F.col(digit)).drop(digit)
        at += window
        window *= GROWTH


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept_id): every row whose text an other row that is kept has. An id column called kept_id keeps its name, and the added one
    gets an underscore."""
    kept_id = "kept_id" + "_" * (id_col.lower() == "kept_id")
    rows = projected(docs, id=id_col, text=text_col)
    _, equal = _levels(rows, F.col("text"), "g", "d")
    if not equal:
        return rows.where("false").select(F.col("id").alias(id_col), F.col("id").alias(kept_id))
    numbered = _union([e.select("id", "g", F.lit(k).alias("level")) for k, e in enumerate(equal)])
    heads = numbered.groupBy("level", "g").agg(F.min("id").alias("kept"), F.count("*").alias("rows"))
    per_id = numbered.groupBy("level", "g", "id").agg(F.count("*").alias("n")).join(heads, ["level", "g"])
    listed = per_id.withColumn("n", F.col("n") - F.when(F.col("id").eqNullSafe(F.col("kept")), 1).otherwise(0)).where("n > 0")
    return listed.select(F.col("id").alias(id_col), F.col("kept").alias(kept_id), F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one of each text, all columns kept."""
    group, digit = fresh(docs.columns, "group"), fresh(docs.columns, "digit")
    alone, equal = _levels(docs, col(text_col), group, digit)
    whole = F.struct(*(col(c) for c in docs.columns))
    order = F.struct(col(id_col).isNull(), col(id_col))
    for e in equal:
        first = e.groupBy(group).agg(F.min_by(whole, order).alias(digit))
        alone.append(first.select(*(F.col(digit).getField(c).alias(c) for c in docs.columns)))
    return _union([a.select(*(col(c) for c in docs.columns)) for a in alone])


OP3_SQL = """
SELECT doc_id, kept_id
FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place
  FROM documents WHERE text IS NOT NULL
) WHERE place > 1
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_id) of every document whose text a kept one has."""
    return finished(spark, lambda: exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")), "exact-duplicates")
