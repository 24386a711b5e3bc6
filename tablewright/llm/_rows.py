"""Row numbers that every job sees alike, and stages that leave nothing behind."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, scratch_path  # noqa: F401 - for the operators here

#: The stored row number. Callers' tables have no column of this name.
PLACE = "__place"


def steady(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or ``columns`` of it, written once with a number for each row in ``PLACE``; as it is when it has that already.

    ``monotonically_increasing_id`` depends on how a job splits its input, which can follow the cores alive when the job
    is planned, and behind a shuffle on the order of arrival. Stored, a row has the same number in every job and retry.
    """
    if PLACE in df.columns:
        return df
    return cut_lineage((df.select(*columns) if columns else df).withColumn(PLACE, F.monotonically_increasing_id()), "rows")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _with(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``cut_lineage``, after which the shuffle files of the finished query go.

    Otherwise they stay until the driver happens to collect its garbage, which in a run of several large queries
    may be far too late for the disks. The written stage needs them no more.
    """
    with _with(df.sparkSession, _CLEANUP, "true"):
        return cut_lineage(df, name)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """``cut`` for one table of several, written one after the other: the shuffle files of one go before the next begins."""
    path = None
    for df in parts:
        path = path or scratch_path(df.sparkSession, name)
        with _with(df.sparkSession, _CLEANUP, "true"):
            df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def dealt(df: DataFrame, share: Column, shares: int, name: str) -> list[DataFrame]:
    """``df`` written as up to ``shares`` tables by the number ``share``, each of which can be discarded by itself. Rows are not sorted for it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with _with(spark, _WRITERS, str(shares)):
        df.withColumn("__share", share).write.partitionBy("__share").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files, kept = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.read.schema(df.schema)
    found = [name for name in (f"{path}/__share={k}" for k in range(shares)) if files.exists(at(name))]
    return [kept.parquet(name) for name in found or [path]]
