"""Table shape, column profile, samples, duplicates, roles and candidate targets.

All columns are counted in one scan (``value_counts.py``), long texts by digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.dates import parse_datetime
from ..functions.text import as_text, char_count, row_digest, word_count
from ..functions.types import clean_value, is_bool, is_datetime, is_number
from .value_counts import is_null, value_counts

# Name fragments that, with nearly unique values, mark an identifier.
IDENTIFIER_HINTS = ["id", "uuid", "code", "number"]
ROLES = ["target", "categorical", "datetime", "numeric", "identifier", "datetime_candidate", "text"]


def _family(dtype: T.DataType) -> str:
    if is_bool(dtype):
        return "bool"
    if is_datetime(dtype):
        return "datetime"
    if is_number(dtype) or isinstance(dtype, T.NullType):
        return "number"
    return "other"


def column_list(df: DataFrame) -> DataFrame:
    """One line per column: name, position, type."""
    rows = [(f.name, i, f.dataType.simpleString(), _family(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, dtype string, family string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def sketch_distinct(value: Column, log_size: int = 12) -> Column:
    """Approximate distinct count by an HLL sketch: one small object, whatever the column."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(log_size)))


def _exact_sums(df: DataFrame, counts: DataFrame | None) -> DataFrame:
    """One line of sums for each column, from its distinct values and their counts.

    Text is measured per distinct value. A long text brings its sizes along; it is longer than any date.
    """
    n, zero, text = F.col("n"), F.lit(0).cast("bigint"), F.col("text")
    measured = F.array(*[F.lit(i) for i, f in enumerate(df.schema) if _family(f.dataType) == "other"]).cast("array<int>")
    asked = F.array_contains(measured, F.col("position"))
    present = F.when(~is_null(), n).otherwise(zero)
    dated = asked & F.col("digest").isNull() & parse_datetime(F.when(asked, text)).isNotNull()
    sums = (value_counts(df) if counts is None else counts).groupBy("position").agg(
        F.sum("n").alias("rows"),
        F.sum(present).alias("present"),
        F.sum(F.when(~is_null(), 1).otherwise(0)).cast("bigint").alias("distinct"),
        F.sum(F.when(asked, n * F.coalesce("chars", char_count(text))).otherwise(zero)).alias("chars"),
        F.sum(F.when(asked, n * F.coalesce("words", word_count(text))).otherwise(zero)).alias("words"),
        F.sum(F.when(dated, n).otherwise(zero)).alias("dates"),
    )
    # A table without rows has no lines, but its columns have sums.
    every = column_list(df).select("column", "position")
    filled = every.join(F.broadcast(sums), "position", "left")
    return filled.select("column", *[F.coalesce(c, zero).alias(c) for c in ("rows", "present", "distinct", "chars", "words", "dates")])


def _sketch_sums(df: DataFrame) -> DataFrame:
    """The same lines in one pass without a shuffle of values, distinct counts by sketch."""
    aggs, entries = [F.count(F.lit(1)).alias("rows")], []
    zero = F.lit(0).cast("bigint")
    for i, f in enumerate(df.schema):
        value = clean_value(f)
        aggs += [F.count(value).alias(f"n{i}"), sketch_distinct(value).alias(f"a{i}")]
        measures = [zero] * 3
        if _family(f.dataType) == "other":
            text = as_text(f)
            aggs += [
                F.sum(char_count(text).cast("bigint")).alias(f"c{i}"),
                F.sum(word_count(text).cast("bigint")).alias(f"w{i}"),
                F.count(parse_datetime(text)).alias(f"d{i}"),
            ]
            measures = [F.col(f"{x}{i}") for x in "cwd"]
        entries.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.col("rows"),
                F.col(f"n{i}").alias("present"),
                F.coalesce(F.col(f"a{i}"), zero).alias("distinct"),
                *[m.alias(c) for m, c in zip(measures, ("chars", "words", "dates"))],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def column_stats(df: DataFrame, distinct: str = "exact", counts: DataFrame | None = None) -> DataFrame:
    """Per column: position, type, rows, missing, distinct and, for text, mean sizes.

    All columns come from one scan, or from the ``value_counts`` of ``df`` where they are given. ``distinct="approx"``
    replaces the shuffle of distinct values by sketches.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError(f"unknown distinct method: {distinct}")
    if distinct == "approx":
        sums = _sketch_sums(df)
    else:
        sums = _exact_sums(df, counts)
    present = F.coalesce("present", F.lit(0).cast("bigint"))
    mean = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), present.cast("double")), F.lit(0.0))
    # One line per column on either side.
    return column_list(df).join(F.broadcast(sums), "column").select(
        "column",
        "position",
        "dtype",
        "family",
        "rows",
        (F.col("rows") - present).alias("missing"),
        present.alias("present"),
        "distinct",
        mean("chars").alias("avg_len"),
        mean("words").alias("avg_words"),
        mean("dates").alias("parse_ratio"),
    )


def role_rule(target: str | None = None) -> Column:
    """The role of a column as an expression over ``column_stats``; first match wins."""
    ratio = F.col("distinct") / F.greatest(F.col("present"), F.lit(1))
    name = F.lower("column")
    hinted = F.lit(False)
    for hint in IDENTIFIER_HINTS:
        hinted = hinted | name.contains(hint)
    identifier = (ratio > 0.98) & hinted
    family = F.col("family")
    other = (
        F.when(identifier, "identifier")
        .when((F.col("parse_ratio") >= 0.8) & (F.col("avg_len") >= 6), "datetime_candidate")
        .when((F.col("avg_len") >= 35) | (F.col("avg_words") >= 4) | (ratio >= 0.5), "text")
        .otherwise("categorical")
    )
    return (
        F.when(F.col("column") == F.lit(target), "target")
        .when(family == "bool", "categorical")
        .when(family == "datetime", "datetime")
        .when(family == "number", F.when(identifier, "identifier").otherwise("numeric"))
        .otherwise(other)
    )


def roles_frame(df: DataFrame, target: str | None = None, distinct: str = "exact", counts: DataFrame | None = None) -> DataFrame:
    """``(column, position, role)``."""
    return column_stats(df, distinct, counts).select("column", "position", role_rule(target).alias("role"))


def infer_roles(
    df: DataFrame, target: str | None = None, distinct: str = "exact", counts: DataFrame | None = None
) -> dict[str, str]:
    """Roles as a dict in column order; one row per column reaches the driver."""
    rows = roles_frame(df, target, distinct, counts).collect()
    return {r["column"]: r["role"] for r in sorted(rows, key=lambda r: r["position"])}


def columns_by_role(roles: DataFrame) -> DataFrame:
    return roles.groupBy("role").agg(F.sort_array(F.collect_list("column")).alias("columns"))


def column_profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """Type, role, missing and distinct count of each column."""
    return column_stats(df, distinct).select(
        "column", "position", "dtype", role_rule().alias("role"), "missing", "distinct"
    )


def column_samples(df: DataFrame, n: int = 3, order_by: str | None = None) -> DataFrame:
    """The first ``n`` present values of each column as strings.

    A DataFrame has no row order: rows are ordered by ``order_by`` and, within ties or
    without it, by value. Each column keeps ``n`` candidates per task.
    """
    order = clean_value(df.schema[order_by]) if order_by else F.lit(None).cast("int")
    firsts = [
        df.select(F.lit(f.name).alias("column"), order.alias("row_order"), as_text(f).alias("value"))
        .filter(F.col("value").isNotNull())
        .orderBy("row_order", "value")
        .limit(n)
        for f in df.schema
    ]
    ranked = [
        t.select("column", F.row_number().over(W.partitionBy("column").orderBy("row_order", "value")).alias("rank"), "value") for t in firsts
    ]
    return reduce(DataFrame.unionAll, ranked)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row, in one scan that shuffles 128-bit row digests only."""
    groups = df.groupBy(*row_digest(df)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def candidate_targets(df: DataFrame, limit: int = 10, distinct: str = "exact") -> DataFrame:
    """Columns fit as targets, the first ``limit`` per task in column order."""
    profile = column_profile(df, distinct)
    task = F.when((F.col("role") == "numeric") & (F.col("distinct") > 10), "regression").when(
        (F.col("role") == "categorical") & F.col("distinct").between(2, 25), "classification"
    )
    rank = F.row_number().over(W.partitionBy("task").orderBy("position"))
    return (
        profile.withColumn("task", task)
        .filter(F.col("task").isNotNull())
        .withColumn("rank", rank)
        .filter(F.col("rank") <= limit)
        .select("task", "rank", "column")
    )


def schema_snapshot(df: DataFrame, target: str | None = None, distinct: str = "exact") -> DataFrame:
    """One line: rows, columns, target and the columns of every role."""
    stats = column_stats(df, distinct).withColumn("role", role_rule(target))
    lists = [
        F.sort_array(
            F.collect_list(F.when(F.col("role") == role, F.struct("position", "column")))
        ).getField("column").alias(role)
        for role in ROLES
        if role != "target"
    ]
    return stats.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.lit(target).cast("string").alias("target"),
        *lists,
    )


