"""Text measures and row digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import clean_value

# Strings longer than this are represented by their SHA-256 in grouping keys, so
# that long texts are not shuffled whole when only equality matters.
LONG_TEXT = 64


def char_count(value: Column) -> Column:
    """Characters; a missing text has none."""
    return F.length(F.coalesce(value.cast("string"), F.lit("")))


def word_count(value: Column) -> Column:
    """Whitespace-separated tokens, counting Unicode spaces as separators."""
    return F.regexp_count(F.coalesce(value.cast("string"), F.lit("")), F.lit(r"(?U)\S+"))


def as_text(field: T.StructField) -> Column:
    """String form of a column, NaN as missing."""
    return clean_value(field).cast("string")


def digest(*values: Column) -> list[Column]:
    """128 bits of hash as two longs. Nulls, which the hash skips, are told apart by flags."""
    flags = [v.isNull() for v in values]
    return [F.xxhash64(F.lit(seed), *flags, *values).alias(f"digest{seed}") for seed in (1, 2)]


def row_digest(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The digest of whole rows; nested values count by their text."""
    fields = [df.schema[c] for c in (columns or df.columns)]
    nested = (T.ArrayType, T.MapType, T.StructType)
    return digest(*[as_text(f) if isinstance(f.dataType, nested) else clean_value(f) for f in fields])


def digest_text(*values: Column) -> Column:
    """The digest as 32 hex digits."""
    return F.concat(*[F.lpad(F.hex(d), 16, "0") for d in digest(*values)])
