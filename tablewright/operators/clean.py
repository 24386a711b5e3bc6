"""Cleaning: drop columns and rows, de-duplicate, fill gaps, clip outliers.

Statistics are computed in a few wide aggregates and return to the plan as literals,
so each step is one projection. By default they use all rows, before any split, as
the behaviour to match does; ``fit`` takes another table (for example the training
part) to learn them from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double, clean_value, col, is_bool, is_float, is_number, numeric_columns
from ..session import cut_lineage
from .distributions import modes
from .profile import infer_roles
from .quantiles import iqr_bounds, quantiles


@dataclass(frozen=True)
class CleanConfig:
    """Choices of the cleaning chain. ``reason`` is kept in the report."""

    drop_columns: Sequence[str] = ()
    drop_rows: Sequence[Mapping[str, object]] = ()
    numeric_fill: str = "median"
    categorical_fill: str = "mode"
    fill_constant: str = "missing"
    outliers: str = "iqr_clip"
    skip_roles: Sequence[str] = ()
    quantile_method: str = "exact"
    reason: str = ""

    def __post_init__(self):
        allowed = {
            "numeric_fill": ("median", "mean", "none"),
            "categorical_fill": ("mode", "constant", "none"),
            "outliers": ("iqr_clip", "none"),
            "quantile_method": ("exact", "approx"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}, not {getattr(self, name)!r}")


@dataclass
class CleanResult:
    data: DataFrame
    report: DataFrame
    roles: dict[str, str] = field(default_factory=dict)


def drop_columns(df: DataFrame, names: Sequence[str] | str) -> DataFrame:
    """Drop columns by name, given as a list or comma-separated; unknown names are ignored."""
    if isinstance(names, str):
        names = [n.strip() for n in names.split(",") if n.strip()]
    return df.drop(*[n for n in names if n in df.columns])


def _matches(df: DataFrame, name: str, value: object) -> Column:
    """Rows where the column's string form is ``value``; never null.

    Numbers compare as numbers, booleans by name, and "nan" stands for missing.
    """
    spec = df.schema[name]
    if value is None or (isinstance(value, float) and value != value) or str(value) == "nan":
        return clean_value(spec).isNull()
    if is_bool(spec.dataType):
        same = col(name).cast("string") == F.lit(str(value).lower())
    elif is_number(spec.dataType):
        try:
            number = float(str(value))
        except ValueError:
            return F.lit(False)
        exact_int = not is_float(spec.dataType) and number.is_integer() and abs(number) < 2**53
        same = col(name) == F.lit(int(number)) if exact_int else clean_value(spec).cast("double") == F.lit(number)
    else:
        same = col(name).cast("string") == F.lit(str(value))
    return F.coalesce(same, F.lit(False))


def drop_rows(df: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """Drop the rows that match any ``{"column": ..., "value": ...}`` rule."""
    for rule in rules:
        name = rule.get("column")
        if name in df.columns:
            df = df.filter(~_matches(df, name, rule.get("value")))
    return df


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; copies merge before the shuffle."""
    return df.dropDuplicates()


def drop_null_target(df: DataFrame, target: str | None) -> DataFrame:
    if target and target in df.columns:
        return df.filter(clean_value(df.schema[target]).isNotNull())
    return df


def _fillable(df: DataFrame, columns: Sequence[str] | None, target: str | None) -> list[str]:
    names = numeric_columns(df, exclude=target) if columns is None else list(columns)
    return [c for c in names if not is_bool(df.schema[c].dataType)]


def _fill_double(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    filled = {
        name: F.coalesce(as_double(df, name), F.lit(float(value))) for name, value in values.items() if value is not None
    }
    return df.withColumns(filled) if filled else df


def fill_median(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    target: str | None = None,
    fit: DataFrame | None = None,
    method: str = "exact",
) -> DataFrame:
    """Fill numeric gaps with the median; filled columns become double."""
    names = _fillable(df, columns, target)
    medians = quantiles(df if fit is None else fit, names, [0.5], method)
    return _fill_double(df, {c: medians[c][0] for c in names})


def fill_mean(
    df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None, fit: DataFrame | None = None
) -> DataFrame:
    """Fill numeric gaps with the mean; filled columns become double."""
    names = _fillable(df, columns, target)
    if not names:
        return df
    source = df if fit is None else fit
    row = source.agg(*[F.avg(as_double(source, c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return _fill_double(df, {c: row[f"m{i}"] for i, c in enumerate(names)})


def fill_mode(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Fill gaps with the most frequent value, ties to the smallest."""
    found = modes(df if fit is None else fit, list(columns))
    filled = {c: F.coalesce(col(c), F.lit(found[c]).cast(df.schema[c].dataType)) for c in columns if c in found}
    return df.withColumns(filled) if filled else df


def fill_constant(df: DataFrame, columns: Sequence[str], constant: str) -> DataFrame:
    """Fill gaps of string columns with a constant; booleans, which cannot hold it, stay."""
    text = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    return df.withColumns({c: F.coalesce(col(c), F.lit(constant)) for c in text}) if text else df


def clip_iqr(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    target: str | None = None,
    fit: DataFrame | None = None,
    method: str = "exact",
) -> DataFrame:
    """Pull values beyond the interquartile fences onto them; missing stays missing."""
    fences = iqr_bounds(df if fit is None else fit, _fillable(df, columns, target), method=method)
    clipped = {}
    for name, (low, high) in fences.items():
        value = as_double(df, name)
        clipped[name] = F.when(value < low, low).when(value > high, high).otherwise(value)
    return df.withColumns(clipped) if clipped else df


def clean(df: DataFrame, config: CleanConfig = CleanConfig(), target: str | None = None) -> CleanResult:
    """The whole chain; fences are taken after filling.

    The de-duplicated rows are written once to the shared folder, since the statistics
    passes and the result all start from them.
    """
    kept = drop_rows(drop_columns(df, config.drop_columns), config.drop_rows)
    rows = cut_lineage(drop_null_target(drop_duplicates(kept), target), "cleaned")
    roles = infer_roles(rows, target)
    numeric = [c for c in _fillable(rows, None, target) if roles[c] not in config.skip_roles]
    categorical = [c for c, r in roles.items() if r == "categorical" and c != target]

    out = rows
    if config.numeric_fill == "median":
        out = fill_median(out, numeric, method=config.quantile_method)
    elif config.numeric_fill == "mean":
        out = fill_mean(out, numeric)
    if config.categorical_fill == "mode":
        out = fill_mode(out, categorical)
    elif config.categorical_fill == "constant":
        out = fill_constant(out, categorical, config.fill_constant)
    if config.outliers == "iqr_clip":
        out = clip_iqr(out, numeric, method=config.quantile_method)
    return CleanResult(out, clean_report(df, rows, config.reason), roles)


def clean_report(before: DataFrame, after: DataFrame, reason: str = "") -> DataFrame:
    """Row counts before and after; counting reads no column."""
    one = F.lit(1)
    counts = before.agg(F.count(one).alias("n")).withColumn("stage", F.lit("before"))
    counts = counts.unionAll(after.agg(F.count(one).alias("n")).withColumn("stage", F.lit("after")))
    return counts.agg(
        F.sum(F.when(F.col("stage") == "before", F.col("n"))).alias("rows_before"),
        F.sum(F.when(F.col("stage") == "after", F.col("n"))).alias("rows_after"),
    ).withColumn("reason", F.lit(reason))
