"""Operator 4: line dedup over levelled sorted runs of line hashes.

Batches come in order. A batch's distinct lines (by 128 bits of hash) are merge-anti-joined with every run
so far; what is new becomes a run of level 0. When a level holds `fanout` runs they are compacted
into one of the next level. A run has one sorted file for each bucket of hashes: a batch's join reads the runs in their order, neither
shuffling nor sorting them again. A compaction moves the hashes of the runs that it merges, each of them once a level.

The places of repeated lines meet their hashes in a hash join, and documents the lines that they lose in another one; both have a plan
that doesn't depend on sizes, and their skewed partitions can be split. A hash's first place is added up before anything moves.

A line that comes again, in its own text or a later one, is dropped; the first in the order of batches, ids
and places stays. Blank lines (empty or spaces) always stay.

Defined cases: a null text stays null with n_dropped 0; an empty text stays empty; rows with a
null id come last; rows that repeat an id and text share their lines' fate, as they
can't be told apart; extra columns are kept, and if one has the name of the added count, that gets underscores; ids may be numbers,
dates, times or strings (any others that can be ordered make a single batch); empty batches add nothing.
"""

from __future__ import annotations

import uuid
from contextlib import AbstractContextManager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, discard, finished, fresh, fresh_path, materialise, projected, setting, unused, value_cuts

HASH = ["h1", "h2"]
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _sorted_runs(spark: SparkSession) -> AbstractContextManager[None]:
    """While plans are made within, Spark trusts the order of bucket files, which holds as each bucket is one file."""
    return setting(spark, _ORDERED, "true")


class LineDedup:
    """The runs of a growing corpus; add() takes a batch and returns it without repeated lines."""

    def __init__(self, spark: SparkSession, buckets: int = 48, fanout: int = 3) -> None:
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[tuple[str, str]]] = []

    def _write_run(self, hashes: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh_path(self.spark, "line-run")
        hashes.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        return name, path

    def _add_run(self, hashes: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write_run(hashes))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            # by their paths: as tables they would be taken for partitioned already, and each bucket have a file from each run
            self._add_run(self.spark.read.schema("h1 long, h2 long").parquet(*(p for _, p in runs)), level + 1)
            self._forget(runs)

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, [p for _, p in runs])

    def close(self) -> None:
        for runs in self.levels:
            self._forget(runs)
        self.levels = []

    def _lines(self, docs: DataFrame) -> DataFrame:
        lines = docs.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        full = lines.where(F.trim("line") != "")
        return full.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "id", "th", "pos")

    def _met(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, first, n, seen): a batch's distinct hashes, and whether any run has them."""
        place = F.struct(F.col("id").isNull().alias("no"), "id", "pos")
        found = lines.groupBy(*HASH).agg(F.min(place).alias("first"), F.count("*").alias("n"))
        marks = []
        for runs in self.levels:
            for name, _ in runs:
                marks.append(f"in_{name}")
                found = found.join(self.spark.table(name).withColumn(marks[-1], F.lit(True)).hint("merge"), HASH, "left")
        seen = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in marks), F.lit(False))
        return found.select(*HASH, F.when(~seen, F.col("first")).alias("first"), "n", seen.alias("seen"))

    def _dropped(self, docs: DataFrame) -> DataFrame:
        """(id, th, dropped array<int>) of the rows that lose lines; adds the batch's run."""
        lines = self._lines(docs)
        place = F.struct(F.col("id").isNull().alias("no"), "id", "pos")
        with _sorted_runs(self.spark):
            found, path = materialise(self._met(lines), "line-batch")
        self._add_run(found.where("not seen").select(*HASH))
        repeated = found.where("seen or n > 1").select(*HASH, "first").hint("shuffle_hash")
        again = lines.join(repeated, HASH).where(~place.eqNullSafe(F.col("first")))
        out, _ = materialise(again.groupBy("id", "th").agg(F.collect_set("pos").alias("dropped")), "line-drops")
        discard(self.spark, [path])
        return out

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_dropped") -> DataFrame:
        """The batch with its repeated lines gone, and how many lines each row lost."""
        drops = self._dropped(projected(docs, id=id_col, text=text_col).where("text is not null"))
        i, h, d, t = (fresh(docs.columns, x) for x in ("id", "th", "dropped", "text"))
        count_col = unused(count_col, {c.lower() for c in docs.columns})
        drops = drops.select(F.col("id").alias(i), F.col("th").alias(h), F.col("dropped").alias(d)).hint("shuffle_hash")
        tagged = docs.withColumn(t, F.xxhash64(col(text_col)))
        joined = tagged.join(drops, col(id_col).eqNullSafe(drops[i]) & (tagged[t] == drops[h]), "left")
        kept = F.array_join(F.filter(F.split(col(text_col), "\n"), lambda _, k: ~F.array_contains(F.col(d), k)), "\n")
        columns = [F.when(F.col(d).isNull(), col(c)).otherwise(kept).alias(c) if c == text_col else col(c) for c in docs.columns]
        return joined.select(*columns, F.when(F.col(d).isNull(), F.lit(0)).otherwise(F.size(d)).cast("long").alias(count_col))


def batch_conditions(docs: DataFrame, id_col: str, batches: int) -> list[Column]:
    """Ranges of the id, of about equal numbers of rows, as conditions that a scan can take."""
    kind, of = docs.schema[id_col].dataType, col(id_col)
    cuts: list = []
    if batches > 1 and isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        cuts = docs.agg(F.percentile_approx(of, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    elif batches > 1 and isinstance(kind, T.StringType):
        cuts = value_cuts(docs, of, batches)[: batches - 1]
    cuts = sorted(set(cuts))
    if not cuts:
        return [F.lit(True)]
    lit = [F.lit(c).cast(kind) for c in cuts]
    return [of <= lit[0], *((of > a) & (of <= b) for a, b in zip(lit, lit[1:])), (of > lit[-1]) | of.isNull()]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4) -> DataFrame:
    """All of docs as `batches` batches of about equal numbers of rows, in the order of the id."""
    runs = LineDedup(docs.sparkSession)
    parts = [runs.add(docs.where(part), id_col, text_col) for part in batch_conditions(docs, id_col, batches)]
    runs.close()
    return reduce(DataFrame.unionByName, parts)


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, line, pos, trim(line) = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS stays FROM lines
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text,
       count(*) FILTER (WHERE NOT stays) AS n_dropped
FROM placed GROUP BY doc_id
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier place has."""
    return finished(spark, lambda: dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "lines")
