"""Parquet tables: scans, stage tables and split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .csv import has_quoted_breaks, parse_records, quoted_records


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a stage table and return the reader over the written files.

    ``fmt="csv"`` leaves a header-bearing CSV for tools that want one.
    """
    if fmt == "csv":
        write_csv(df, path)
        if has_quoted_breaks(df.sparkSession, path):
            return parse_records(quoted_records(df.sparkSession, path), df.schema)
        return df.sparkSession.read.schema(df.schema).options(header=True, escape='"').csv(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header; blanks at the ends of a text stay."""
    space = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', sep=sep, **space).csv(path)


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """Write a table with a ``split`` column so that each part can be read alone."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    # The declared schema keeps ``split`` a string and avoids inference.
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_split(spark: SparkSession, path: str, *parts: str) -> DataFrame:
    from pyspark.sql import functions as F

    return spark.read.parquet(path).filter(F.col("split").isin(*parts)).drop("split")
