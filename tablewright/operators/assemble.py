"""Joining several tables on common keys into one modelling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_dimensions(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Inner-join ``(dimension, fact key, dimension key)`` in turn, dimension key dropped.

    No broadcast is forced: file statistics and AQE pick it for small dimensions, and
    the skew join splits a hot foreign key on the fact side.
    """
    out = fact
    for table, fact_key, dim_key in dimensions:
        out = out.join(table.withColumnRenamed(dim_key, "_key"), F.col(fact_key) == F.col("_key")).drop("_key")
    return out
