"""What the training-data operators share: the shared folder, materialised tables, names and keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing a temporary folder serves a single-machine session; a cluster
    without the setting is an error, because a machine-local folder would lose tables with it.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        active = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = active.get() if active.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the plans that are made and run within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


#: Rows of whole texts that go to Python at once: a batch is held several times over, in the JVM and in the worker.
TEXTS_A_BATCH = "1000"


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """For plans that send whole texts to Python and are run within."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_A_BATCH)


def give_back() -> None:
    """Returns to the system what this Python worker has freed. Workers stay after their tasks, and else keep it while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that materialise() wrote within it."""
    _scratch.append([])
    try:
        yield
    finally:
        discard(spark, _scratch.pop())


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost
    executor costs nothing that was already written. It stays until discard(), or the end of the scratch() around it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete intermediate tables that no returned plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def finished_at(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> tuple[DataFrame, str]:
    """make()'s result as a table in the shared folder, and its path; what was written on the way to it is deleted."""
    path = fresh_path(spark, tag)
    with scratch(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path), path


def finished(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    return finished_at(spark, make, tag)[0]


def value_cuts(df: DataFrame, value: Column, levels: int) -> list:
    """The values at which the running count of rows, in the order of the value, passes a multiple of 1 / levels, in that
    order; the greatest value is the last. Nulls count, as the least value. No more than `levels` values come to the driver."""
    spark = df.sparkSession
    counts = df.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    # written, so that the ranges stay; their numbers are in the order of the values
    ranged, path = materialise(counts.repartitionByRange(F.col("v").asc_nulls_first()).withColumn("range", F.spark_partition_id()), "values")
    total, starts = 0, []
    for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():
        starts.append((r["range"], total))
        total += r["n"]
    cuts = []
    if total:
        upto = F.sum("n").over(Window.partitionBy("range").orderBy(F.col("v").asc_nulls_first())) + F.col("start")
        run = ranged.join(F.broadcast(spark.createDataFrame(starts, "range int, start long")), "range").select("v", "n", upto.alias("upto"))
        passed = run.where((F.floor(F.col("upto") * levels / total) > F.floor((F.col("upto") - F.col("n")) * levels / total)) & F.col("v").isNotNull())
        cuts = [r["v"] for r in passed.orderBy("upto").select("v").collect()]
    discard(spark, [path])
    return cuts


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name that the table doesn't have yet (names are compared without case)."""
    taken = {c.lower() for c in columns}
    return unused(f"_pw_{base}", taken)


def unused(name: str, taken: Iterable[str]) -> str:
    """A name, with as many underscores at its end as it takes to be none of those that are taken (in lower case)."""
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def projected(df: DataFrame, **columns: str | None) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns can't clash."""
    return df.select(*(col(c).alias(k) for k, c in columns.items() if c is not None))
