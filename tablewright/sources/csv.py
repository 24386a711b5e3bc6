"""CSV scan with delimiter detection and type inference."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import col
from ..operators.lookup import BROADCAST_ROWS, local_copy
from ..session import cut_lineage

# Strings read as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Strings read as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

INTEGER_SHAPE = r"^\s*[+-]?\d+\s*$"
NUMBER_SHAPE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def sniff_delimiter(header: str) -> str:
    """``;`` only where the header holds strictly more of them than commas."""
    return ";" if header.count(";") > header.count(",") else ","


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header record; blanks and repeats are renamed."""
    names: list[str] = []
    seen: Counter[str] = Counter()
    for position, raw in enumerate(next(csv.reader(io.StringIO(header, newline=""), delimiter=sep))):
        base = raw if raw.strip() else f"Unnamed: {position}"
        name = base
        while name in names:
            seen[base] += 1
            name = f"{base}.{seen[base]}"
        names.append(name)
    return names


# Takes fields beyond the header; no name in a header holds this character.
SURPLUS = "\0surplus"


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a line may end within quotes: one with an odd number of them.

    A parallel pass that stops at the first such line.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


_LINES = "file string, block bigint, seq bigint, value string, odd boolean, inside boolean, start_out bigint, start_in bigint"


def _mark_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a byte range with what is known of them without the ranges before.

    ``inside``: an odd number of quotes stands before the line in its range; ``start_out`` and ``start_in``: the line of the range in which its
    record starts if the range itself starts outside or inside quotes, -1 if that is in an earlier range.
    """
    here, seq, parity, starts = None, 0, 0, [-1, -1]
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        edges = [0, *[i for i in range(1, len(files)) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])], len(files)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if (files[a], blocks[a]) != here:
                here, seq, parity, starts = (files[a], blocks[a]), 0, 0, [-1, -1]
            part = batch.slice(a, b - a)
            odd = np.asarray(pc.count_substring(part.column("value"), '"'), np.int64) & 1
            inside = (parity + np.cumsum(odd) - odd) & 1
            place = seq + np.arange(b - a)
            found = [np.maximum.accumulate(np.maximum(np.where(inside == s, place, -1), starts[s])) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [part.column("file"), part.column("block"), pa.array(place), part.column("value"), pa.array(odd == 1), pa.array(inside == 1), *map(pa.array, found)],
                [f.split()[0] for f in _LINES.split(", ")],
            )
            seq, parity, starts = seq + b - a, int(inside[-1] + odd[-1]) & 1, [int(f[-1]) for f in found]


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, header, value)``: the records of CSV files in which quoted fields may go over several lines.

    Every byte range of a file is read by its own task, which can't know whether it starts within quotes. So it counts quotes from
    its start and reports their parity; a prefix sum over the ranges of each file, one short row for each, tells the state in which
    each range starts, and so the first true record of each. Lines that are a record of their own stay where they are, only
    those of records over several lines are brought together. The marked lines are written once, since later jobs may cut other
    ranges. Quotes belong to quoted fields: one within a field without quotes is against the format.
    """
    source = spark.read.option("lineSep", "\n").text(path)
    source = source.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = cut_lineage(source.mapInArrow(_mark_lines, _LINES), "csv_lines")
    blocks = lines.groupBy("file", "block").agg(
        F.sum(F.col("odd").cast("int")).alias("quotes"), F.max("start_out").alias("last_out"), F.max("start_in").alias("last_in")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("begins_in")
    last = F.when(F.col("begins_in"), F.col("last_in")).otherwise(F.col("last_out"))
    states = blocks.select("*", begins).withColumn("last", last)
    start = F.when(F.col("last") >= 0, F.struct("block", F.col("last").alias("seq")))
    states = states.select("file", "block", "begins_in", F.last(start, ignorenulls=True).over(earlier).alias("open"))
    small = local_copy(states, BROADCAST_ROWS)
    marked = lines.join(states if small is None else F.broadcast(small), ["file", "block"])
    start = F.when(F.col("begins_in"), F.col("start_in")).otherwise(F.col("start_out"))
    marked = marked.withColumn("record", F.when(start >= 0, F.struct("block", start.alias("seq"))).otherwise(F.col("open")))
    quotes_before = F.col("inside").cast("int") + F.col("begins_in").cast("int")
    whole = (quotes_before % 2 == 0) & ~F.col("odd")
    header = (F.col("record.block") == 0) & (F.col("record.seq") == 0)
    longer = marked.filter(~whole).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("lines"))
    # The value depends on the join here, so that nothing asked of records is asked of lines below the join.
    found = marked.filter(whole).select("file", header.alias("header"), F.when(whole, F.col("value")).alias("value")).unionByName(
        longer.select("file", header.alias("header"), F.array_join(F.col("lines.value"), "\n").alias("value"))
    )
    return found.withColumn("value", F.regexp_replace("value", r"\r\z", "")).filter(F.trim("value") != "")


def parse_records(records: DataFrame, schema: T.StructType, sep: str = ",") -> DataFrame:
    """The records (header records left out) as rows of ``schema``."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    options = {"sep": sep, "quote": '"', "escape": '"'}
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain)
    rows = records.filter(~F.col("header")).select(F.from_csv("value", kinds, options).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema)])


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Read a CSV file or folder of CSV files with the same header.

    Files are split between tasks, whether or not quoted fields go over several lines (``quoted_records``). A record with more
    fields than the header fails; one with fewer has nulls.
    """
    multiline = has_quoted_breaks(spark, path)
    if multiline:
        records = quoted_records(spark, path)
        first = records.filter("header").orderBy("file").select("value").limit(1).collect()
    else:
        first = spark.read.text(path).limit(1).collect()
    header = first[0][0].lstrip("﻿") if first else ""
    if not header.strip():
        return spark.createDataFrame([], T.StructType([]))
    sep = sniff_delimiter(header)
    names = header_names(header, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])
    if multiline:
        raw = parse_records(records, schema, sep)
    else:
        raw = (
            spark.read.schema(schema)
            .option("sep", sep)
            .option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("encoding", "UTF-8")
            .option("enforceSchema", True)
            .csv(path)
        )
    surplus = F.raise_error(F.concat(F.lit(f"a record has more than {len(names)} fields: "), SURPLUS))
    raw = raw.filter(F.when(F.col(SURPLUS).isNotNull(), surplus.cast("boolean")).otherwise(True)).drop(SURPLUS)
    return infer_types(raw) if infer else raw


def blank_to_null(name: str) -> Column:
    return F.when(~col(name).isin(NULL_TOKENS), col(name))


def infer_types(raw: DataFrame) -> DataFrame:
    """Give every string column the narrowest of bool, bigint, double, string.

    One aggregate counts, for all columns, how many present values fit each type. A
    column without values is double.
    """
    checks = []
    for i, name in enumerate(raw.columns):
        value = blank_to_null(name)
        fits_int = value.rlike(INTEGER_SHAPE) & F.trim(value).try_cast("bigint").isNotNull()
        checks += [
            F.count(value).alias(f"n{i}"),
            F.count(F.when(value.isin(TRUE_TOKENS + FALSE_TOKENS), 1)).alias(f"b{i}"),
            F.count(F.when(fits_int, 1)).alias(f"i{i}"),
            F.count(F.when(value.rlike(NUMBER_SHAPE), 1)).alias(f"d{i}"),
        ]
    if not checks:
        return raw
    seen = raw.agg(*checks).first()
    casts = []
    for i, name in enumerate(raw.columns):
        value, n = blank_to_null(name), seen[f"n{i}"]
        if n and seen[f"b{i}"] == n:
            typed = F.when(value.isin(TRUE_TOKENS), True).when(value.isin(FALSE_TOKENS), False)
        elif n and seen[f"i{i}"] == n:
            typed = F.trim(value).cast("bigint")
        elif seen[f"d{i}"] == n:
            typed = F.trim(value).cast("double")
        else:
            typed = value
        casts.append(typed.alias(name))
    return raw.select(*casts)
