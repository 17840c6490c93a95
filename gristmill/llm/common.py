"""Shared helpers: scratch tables that cut lineage, and column guards."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import scratch_dir, ship


#: Rows of an Arrow batch: texts can be long, and a batch is held by the JVM and by the worker.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, and bound Arrow batches unless the session sets another size than Spark's own."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def shipped(query: Callable) -> Callable:
    """A query that prepares the session first, its first argument."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        prepare(spark)
        return query(spark, *args)

    return run


def freed(run: Callable) -> Callable:
    """run, a function of Arrow batches, and then the memory it has done with back to the system: idle workers keep the rest."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidy


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of these files, not a
    re-run of what made them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/gristmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gristmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by cut(), once nothing reads it any more."""
    path = getattr(df, "_gristmill_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that tell a row by its id, null too, and its text."""
    return F.struct(F.xxhash64(F.col(doc_id).isNull(), doc_id, text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df unchanged if it has a partition for each core at least, else dealt over the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
