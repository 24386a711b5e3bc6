"""Missing values, correlations, leakage, class balance, outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pair_corr
from ..functions.types import as_double, clean_value, numeric_columns
from .gram import correlations
from .quantiles import iqr_bounds


def _one_row_to_long(row: DataFrame, names: list[str], column: str, value: str) -> DataFrame:
    """Turn an aggregate's single row with fields ``c0..cn`` into named lines."""
    entries = [F.struct(F.lit(n).alias(column), F.col(f"c{i}").alias(value)) for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*entries)))


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, missing)`` from one aggregate over all columns."""
    counts = [F.count(F.when(clean_value(f).isNull(), 1)).alias(f"c{i}") for i, f in enumerate(df.schema)]
    return _one_row_to_long(df.agg(*counts), df.columns, "column", "missing")


def _full_columns(df: DataFrame, names: list[str]) -> set[str]:
    """The columns without gaps; one counting pass."""
    row = df.agg(*[F.count(F.when(as_double(df, n).isNull(), 1)).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return {n for i, n in enumerate(names) if row[f"c{i}"] == 0}


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """``(column, corr)`` of every other numeric column with a numeric target.

    Pairwise complete, null without variance. Empty for a target that is not numeric.
    """
    names = numeric_columns(df, exclude=target)
    if target not in numeric_columns(df) or not names:
        return df.sparkSession.createDataFrame([], "column string, corr double")
    y = as_double(df, target)
    full = _full_columns(df, [target])
    row = df.agg(*[pair_corr(as_double(df, n), y, y_full=target in full).alias(f"c{i}") for i, n in enumerate(names)])
    return _one_row_to_long(row, names, "column", "corr")


def top_correlations(df: DataFrame, target: str, n: int = 10) -> DataFrame:
    corr = target_correlations(df, target)
    return corr.orderBy(F.desc_nulls_last(F.abs("corr")), "column").limit(n)


def leakage_columns(df: DataFrame, target: str, threshold: float = 0.98) -> DataFrame:
    return target_correlations(df, target).filter(F.abs("corr") > threshold)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(x, y, corr)`` for all pairs of numeric columns, both orders.

    Pairwise complete, from one scan (``gram.py``).
    """
    return correlations(df, columns or numeric_columns(df))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows per target value, null included."""
    return df.groupBy(F.col(f"`{target}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def iqr_outliers(df: DataFrame, target: str | None = None, method: str = "exact") -> DataFrame:
    """``(column, outliers)``: rows outside the interquartile fences, target skipped."""
    names = numeric_columns(df, exclude=target)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, outliers bigint")
    fences = iqr_bounds(df, names, method=method)
    counts = []
    for i, name in enumerate(names):
        value = as_double(df, name)
        if name in fences:
            low, high = fences[name]
            counts.append(F.count(F.when((value < low) | (value > high), 1)).alias(f"c{i}"))
        else:
            counts.append(F.lit(0).cast("bigint").alias(f"c{i}"))
    return _one_row_to_long(df.agg(F.count(F.lit(1)).alias("rows"), *counts), names, "column", "outliers")


def eda_report(df: DataFrame, target: str | None, task_type: str | None, method: str = "exact") -> DataFrame:
    """All findings as ``(metric, name, value)``."""

    def lines(part: DataFrame, metric: str, name: str, value: str) -> DataFrame:
        return part.select(
            F.lit(metric).alias("metric"),
            F.col(name).cast("string").alias("name"),
            F.col(value).cast("double").alias("value"),
        )

    rows = df.agg(F.count(F.lit(1)).alias("value")).withColumn("name", F.lit("rows"))
    parts = [
        lines(rows, "shape", "name", "value"),
        lines(rows.withColumn("value", F.lit(len(df.columns))).withColumn("name", F.lit("columns")), "shape", "name", "value"),
        lines(missing_counts(df), "missing", "column", "missing"),
        lines(iqr_outliers(df, target, method), "outliers", "column", "outliers"),
    ]
    if target:
        corr = target_correlations(df, target)
        top = corr.orderBy(F.desc_nulls_last(F.abs("corr")), "column").limit(10)
        parts.append(lines(top, "target_correlation", "column", "corr"))
        parts.append(lines(corr.filter(F.abs("corr") > 0.98), "leakage", "column", "corr"))
        if task_type == "classification":
            parts.append(lines(class_balance(df, target), "class_balance", "value", "n"))
    return reduce(DataFrame.unionAll, parts)


