"""How often each value of each column occurs, for all columns in one scan.

Tasks count the values of a stretch of rows column by column (Arrow); of what they found, short lines with counts are added up
behind one shuffle. Long texts go by digest, a beginning and their sizes. Profiles, roles, top values and modes are read off
the counts; the few long texts that a result shows are fetched by their digests at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import LONG_TEXT, as_text, char_count, word_count
from ..functions.types import clean_value, is_bool, is_float
from ..session import cut_lineage
from .lookup import BROADCAST_ROWS, local_copy

#: The parts of a value: null means that the part does not apply.
PARTS = {"whole": pa.int64(), "real": pa.float64(), "text": pa.string(), "digest": pa.string(), "chars": pa.int32(), "words": pa.int32()}
_LINES = "position int, whole bigint, real double, text string, digest string, chars int, words int, n bigint"
#: Rows and bytes that a task counts at once.
STRETCH_ROWS, STRETCH_BYTES = 1 << 18, 32 << 20


def _is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def _parts(field: T.StructField) -> dict[str, Column]:
    """A value as parts that are equal exactly when the values are. Times are whole numbers, of days or microseconds, once in Arrow."""
    value, dtype = clean_value(field), field.dataType
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"whole": value}
    if is_float(dtype):
        return {"real": value}
    text = as_text(field)
    long = F.length(text) > LONG_TEXT
    parts = {"text": F.when(long, F.substring(text, 1, LONG_TEXT)).otherwise(text), "digest": F.when(long, F.sha2(text, 256))}
    if _is_text(dtype):
        parts |= {"chars": F.when(long, char_count(text)), "words": F.when(long, word_count(text))}
    return parts


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(position, whole, real, text, digest, chars, words, n)``: the values of each column with their counts, null included.

    ``position`` is the column's place in ``columns`` (all by default). Long texts are kept by digest; ``text`` is then their beginning, and
    ``chars`` and ``words`` are their sizes.
    """
    parts = [_parts(df.schema[c]) for c in (columns or df.columns)]
    layout, at = [], 0
    for found in parts:
        layout.append(list(zip(found, range(at, at + len(found)))))
        at += len(found)

    def lines(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        for position, places in enumerate(layout):
            names = [name for name, _ in places]
            keys = pa.table([_plain(table.column(i), PARTS[name]) for name, i in places], names)
            counted = keys.group_by(names, use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            n = counted.num_rows
            if "real" in names:
                # A double's bits tell it from others as well as it does itself, and leave one key less.
                counted = counted.append_column("whole", _bits(counted.column("real")))
            given = [counted.column(p) if p in counted.column_names else pa.nulls(n, kind) for p, kind in PARTS.items()]
            whole = pa.table([pa.array([position] * n, pa.int32()), *given, counted.column("count_all")], ["position", *PARTS, "n"])
            yield from whole.to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= STRETCH_ROWS or size >= STRETCH_BYTES:
                yield from lines(held)
                held, rows, size = [], 0, 0
        if held:
            yield from lines(held)

    chosen = [c.alias(f"p{i}") for i, c in enumerate(c for found in parts for c in found.values())]
    counted = df.select(*chosen).mapInArrow(count, _LINES).groupBy("position", "whole", "text", "digest")
    # The other parts follow from the keys.
    sums = counted.agg(*[F.max(p).alias(p) for p in ("real", "chars", "words")], F.sum("n").alias("n"))
    whole = F.when(F.col("real").isNull(), F.col("whole")).alias("whole")
    return sums.select("position", whole, "real", "text", "digest", "chars", "words", "n")


def _bits(column: pa.ChunkedArray) -> pa.Array:
    values = column.combine_chunks()
    bits = np.asarray(values.fill_null(0.0), np.float64).view(np.int64)
    return pa.array(bits, mask=np.asarray(values.is_null()))


def _plain(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    elif pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    return column.cast(kind)


def is_null() -> Column:
    """Whether a counted value is null."""
    return F.col("whole").isNull() & F.col("real").isNull() & F.col("text").isNull()


def shown(fields: list[T.StructField]) -> Column:
    """A counted value as text; of a long text its beginning."""
    out = F.coalesce("text", F.col("whole").cast("string"), F.col("real").cast("string"))
    for i, f in enumerate(fields):
        here = F.col("position") == i
        if is_bool(f.dataType):
            out = F.when(here, F.col("whole").cast("boolean").cast("string")).otherwise(out)
        elif isinstance(f.dataType, T.FloatType):
            out = F.when(here, F.col("real").cast("float").cast("string")).otherwise(out)
        elif isinstance(f.dataType, T.DateType):
            out = F.when(here, F.date_from_unix_date(F.col("whole").cast("int")).cast("string")).otherwise(out)
        elif isinstance(f.dataType, T.TimestampType):
            out = F.when(here, F.timestamp_micros("whole").cast("string")).otherwise(out)
        elif isinstance(f.dataType, T.TimestampNTZType):
            out = F.when(here, F.expr("timestampadd(MICROSECOND, whole, TIMESTAMP_NTZ'1970-01-01 00:00:00')").cast("string")).otherwise(out)
    return out


def whole_texts(df: DataFrame, columns: list[str], found: DataFrame) -> DataFrame:
    """``found`` with ``value``: the long text of its ``(position, digest)`` where it has a digest, else what ``shown`` gave.

    Only texts that are asked for move: the digests are broadcast when counted to be few, else texts meet them by digest.
    """
    fields = [df.schema[c] for c in columns]
    places = [i for i, f in enumerate(fields) if _is_text(f.dataType)]
    wanted = found.filter("digest is not null").select("position", "digest").distinct()
    small = local_copy(wanted, BROADCAST_ROWS)
    if not places or (small is not None and small.isEmpty()):
        return found.withColumn("value", F.col("shown"))
    texts = F.array(*[F.struct(F.lit(i).alias("position"), as_text(fields[i]).alias("value")) for i in places])
    long = df.select(F.inline(F.filter(texts, lambda t: F.length(t["value"]) > LONG_TEXT))).withColumn("digest", F.sha2("value", 256))
    long = long.join(wanted if small is None else F.broadcast(small), ["position", "digest"], "left_semi")
    long = long.groupBy("position", "digest").agg(F.first("value").alias("value"))
    joined = found.join(long.withColumnsRenamed({"position": "position_", "digest": "digest_"}), (F.col("position") == F.col("position_")) & (F.col("digest") == F.col("digest_")), "left")
    return joined.withColumn("value", F.coalesce("value", F.when(F.col("digest").isNull(), F.col("shown")))).drop("position_", "digest_")


def most_frequent(df: DataFrame, columns: list[str], n: int, order: list[Column], *, nulls: bool, counts: DataFrame | None = None) -> DataFrame:
    """``(position, rank, value, n)``: the ``n`` most frequent values of each column, ties in ``order``, then by whole text.

    Each task keeps its own best ``n`` of a column (and what ties with them) before they meet, so that no task sorts all values
    of one. ``order`` is over the parts of a value, ``shown`` and, of long texts, their beginnings.
    """
    counts = value_counts(df, columns) if counts is None else counts
    counts = counts if nulls else counts.filter(~is_null())
    fields = [df.schema[c] for c in columns]
    ranked = counts.withColumn("shown", shown(fields))
    by_column = W.partitionBy("position").orderBy(F.desc("n"), *order)
    # Long texts with the same beginning tie here, so all of them come through.
    best = cut_lineage(ranked.withColumn("rank", F.rank().over(by_column)).filter(F.col("rank") <= n), "frequent")
    best = whole_texts(df, columns, best)
    final = W.partitionBy("position").orderBy("rank", F.asc_nulls_first("value"))
    best = best.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)
    return best.select("position", "rank", "value", "n")
