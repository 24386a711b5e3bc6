"""Value distributions per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .profile import column_list, column_stats
from .value_counts import most_frequent, value_counts


def top_values(df: DataFrame, n: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """The ``n`` most frequent values of each column with their share of all rows.

    Ties are ordered by the value's text, null first. Each column keeps only its best candidates per task, so a billion
    distinct values cost no sort in one task. ``counts``: the ``value_counts`` of ``df``, if they are there already.
    """
    counts = cut_lineage(value_counts(df), "value_counts") if counts is None else counts
    best = most_frequent(df, df.columns, n, [F.asc_nulls_first("shown")], nulls=True, counts=counts)
    rows = counts.filter("position = 0").agg(F.sum("n").alias("rows")).first()["rows"] or 0
    share = F.round(F.try_divide(F.col("n").cast("double"), F.lit(float(rows))), 4)
    names = column_list(df).select("column", "position")
    return best.join(F.broadcast(names), "position").select("column", "rank", "value", "n", share.alias("share"))


def distribution_report(df: DataFrame, n: int = 20, distinct: str = "exact") -> DataFrame:
    """Top values next to type, missing and distinct count of their column, all from the same counts."""
    counts = cut_lineage(value_counts(df), "value_counts")
    stats = column_stats(df, distinct, counts).select("column", "position", "dtype", "missing", "distinct")
    return stats.join(top_values(df, n, counts), "column", "left")


def column_modes(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``(column, mode, n)``: the most frequent present value as text, ties to the smallest.

    All columns from one scan, or from the ``value_counts`` of the whole ``df`` where they are given; each task keeps its best
    value of a column, so no task holds all of them.
    """
    order, listed = [F.asc("whole"), F.asc("real"), F.asc("text")], columns
    if counts is not None:
        counts, listed = counts.filter(F.col("position").isin([df.columns.index(c) for c in columns])), df.columns
    best = most_frequent(df, listed, 1, order, nulls=False, counts=counts)
    names = df.sparkSession.createDataFrame(list(enumerate(listed)), "position int, column string")
    return best.join(F.broadcast(names), "position").select("column", F.col("value").alias("mode"), "n")


def modes(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> dict[str, str]:
    """Modes of categorical columns; a column without values is left out."""
    if not columns:
        return {}
    return {r["column"]: r["mode"] for r in column_modes(df, columns, counts).collect()}
