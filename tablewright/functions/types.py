"""Column classes by Spark type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_bool(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_number(dtype: T.DataType) -> bool:
    """Numbers without booleans."""
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def numeric_columns(df: DataFrame, exclude: str | None = None) -> list[str]:
    """Columns that count as numeric; booleans are in, as 0/1."""
    return [f.name for f in df.schema if (is_number(f.dataType) or is_bool(f.dataType)) and f.name != exclude]


def quoted(name: str) -> str:
    """A column name safe inside ``F.col`` and SQL text."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def clean_value(field: T.StructField) -> Column:
    """The column with NaN read as missing and -0.0 folded into 0.0."""
    value = col(field.name)
    if is_float(field.dataType):
        return F.when(~F.isnan(value), value + F.lit(0.0).cast(field.dataType))
    return value


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric column as double, NaN as null (booleans become 0/1)."""
    field = df.schema[name]
    if is_bool(field.dataType):
        return col(name).cast("int").cast("double")
    return clean_value(field).cast("double")
