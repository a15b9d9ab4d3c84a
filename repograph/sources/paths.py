"""Small files in the folders that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, with its folders."""
    fs, where = _at(spark, path)
    fs.create(where, True).close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it doesn't exist."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
