"""Features derived from declarative specs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_datetime, date_part
from ..functions.numeric import guarded_ratio
from ..functions.text import as_text, char_count, word_count
from ..functions.types import as_double, clean_value, col, numeric_columns
from .lookup import attach_share
from .profile import roles_frame

# Kinds of features and parts of dates.
ARITHMETIC = ("ratio", "difference", "product", "sum")
KINDS = (*ARITHMETIC, "text_length", "text_word_count", "date_part", "is_missing", "category_frequency")
DATE_PARTS = ("year", "month", "day", "dayofweek", "quarter")


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str
    source_columns: Sequence[str]
    date_part: str | None = None
    denominator_guard: float = 1e-6

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown feature kind: {self.kind}")
        if len(self.source_columns) < (2 if self.kind in ARITHMETIC else 1):
            raise ValueError(f"{self.name}: too few source columns for {self.kind}")
        if self.kind == "date_part" and self.date_part not in DATE_PARTS:
            raise ValueError(f"{self.name}: date_part must be one of {DATE_PARTS}")


def feature_column(df: DataFrame, spec: FeatureSpec) -> Column:
    """The expression of any kind but ``category_frequency``."""
    first = df.schema[spec.source_columns[0]]
    if spec.kind in ARITHMETIC:
        numeric = numeric_columns(df)
        wrong = [c for c in spec.source_columns[:2] if c not in numeric]
        if wrong:
            raise ValueError(f"{spec.name}: {spec.kind} needs numeric columns, not {wrong}")
        a, b = (as_double(df, c) for c in spec.source_columns[:2])
        if spec.kind == "ratio":
            return guarded_ratio(a, b, spec.denominator_guard)
        if spec.kind == "difference":
            return a - b
        return a * b if spec.kind == "product" else a + b
    if spec.kind == "text_length":
        return char_count(as_text(first))
    if spec.kind == "text_word_count":
        return word_count(as_text(first))
    if spec.kind == "date_part":
        return date_part(as_datetime(F.col(f"`{first.name}`"), first.dataType), spec.date_part)
    return clean_value(first).isNull().cast("int")


def plan_levels(columns: Sequence[str], specs: Sequence[FeatureSpec], target: str | None) -> list[list[FeatureSpec]]:
    """Group the usable specs so that each level needs only columns of earlier ones.

    A spec is skipped when its name exists, a source is missing, or a source is the
    target. Order matters: a spec sees only columns made by specs before it.
    """
    level = dict.fromkeys(columns, 0)
    levels: list[list[FeatureSpec]] = []
    for spec in specs:
        if spec.name in level or any(c not in level or c == target for c in spec.source_columns):
            continue
        at = max(level[c] for c in spec.source_columns)
        level[spec.name] = at + 1
        if at == len(levels):
            levels.append([])
        levels[at].append(spec)
    return levels


def derive_features(
    df: DataFrame, specs: Sequence[FeatureSpec], target: str | None = None, fit: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Add the features; one projection per level. Returns the table and the new names.

    ``fit`` is the table that category frequencies are learned from (default: ``df``).
    """
    levels = plan_levels(df.columns, specs, target)
    made = {s.name for level in levels for s in level}
    if not made:
        raise ValueError("no feature could be created: check names and source columns")
    out = df
    for level in levels:
        source = out if fit is None else fit
        out = _add_level(out, level, source)
        fit = None if fit is None else _add_level(fit, level, source)
    names = [s.name for s in specs if s.name in made]
    return out, list(dict.fromkeys(names))


def _add_level(table: DataFrame, level: Sequence[FeatureSpec], source: DataFrame) -> DataFrame:
    plain = {s.name: feature_column(table, s) for s in level if s.kind != "category_frequency"}
    out = table.withColumns(plain) if plain else table
    for spec in level:
        if spec.kind == "category_frequency":
            out = attach_share(out, spec.source_columns[0], spec.name, source)
    return out


def feature_report(df: DataFrame, created: Sequence[str], note: str = "") -> DataFrame:
    """``(position, feature, dtype, note, role)`` of the created features, with the roles that their values have."""
    rows = [(i, name, df.schema[name].dataType.simpleString(), note) for i, name in enumerate(created)]
    report = df.sparkSession.createDataFrame(rows, "position int, feature string, dtype string, note string")
    if not created:
        return report.withColumn("role", F.lit(None).cast("string"))
    # One row for each column on both sides.
    roles = roles_frame(df.select(*[col(c) for c in created])).select(F.col("column").alias("feature"), "role")
    return report.join(F.broadcast(roles), "feature", "left").select("position", "feature", "dtype", "note", "role")
