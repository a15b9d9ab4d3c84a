"""Shared helpers: table access, shared-folder checkpoints and partition counts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import forget_powers

#: ASCII white space of the word contracts: space, tab, LF, VT, FF, CR.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, but only on a master in one JVM; a cluster without a shared folder is an error, since what one
    executor writes to its own disk is lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again, so that later reads take only the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames that are no longer held, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """Gives memory that Arrow and the C library hold for later use back to the system; without the C library's ``malloc_trim``, Arrow's alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with unused memory given back at its end, so that a Python worker that waits for its next task doesn't keep what its largest batches took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget_powers()
            release_memory()

    return tidied


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(docs: DataFrame, each: int = 64 << 20) -> int:
    """Partitions for what is derived from the texts of ``docs`` in proportion: the session's number, or more where that would be over ``each`` bytes of text."""
    n = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), n // each + 1, 2)


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m
