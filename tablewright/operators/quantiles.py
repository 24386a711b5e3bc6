"""Exact quantiles of many columns by radix selection.

A double becomes a 64-bit key that sorts like it. One grouped histogram counts the leading 16 bits of the keys of all columns;
each wanted rank falls into one bucket, and the next pass counts the next 16 bits of the rows in that bucket only.
After four passes at most, fewer where all rows of a bucket are equal, the key is known. No column is sorted or kept as a map of
its values, and a pass moves at most 65,536 short rows for each open bucket from each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.types import as_double

BITS = 16
PASSES = 64 // BITS
#: Histograms of one pass: 32 take 50 MB in a task.
TABLES = 32
#: Buckets of the sketches of ``method="approx"``.
ACCURACY = 10_000

_SIGN = np.uint64(1 << 63)
_COUNTS = "grp int, digit int, n bigint, low bigint, high bigint"


def keys_of(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the values; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def value_of(key: int) -> float:
    """The value of a key."""
    sign = 1 << 63
    bits = key ^ sign if key & sign else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], method: str = "exact"
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; None for a column without values.

    Null and NaN are left out. ``method="approx"`` takes Spark's sketch quantiles in one pass instead.
    """
    if not columns:
        return {}
    values = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    if method == "approx":
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        row = values.agg(*[F.percentile_approx(c, probs, ACCURACY).alias(c) for c in values.columns]).first()
        return {c: list(row[f"v{i}"] or [None] * len(probabilities)) for i, c in enumerate(columns)}
    if method != "exact":
        raise ValueError(f"unknown quantile method: {method}")
    found = _select(values, [float(p) for p in probabilities])
    return {c: [found.get((i, p)) for p in range(len(probabilities))] for i, c in enumerate(columns)}


def _histograms(values: DataFrame, groups: list[tuple[int, int]], depth: int) -> DataFrame:
    """``(grp, digit, n, low, high)``: rows, and least and largest key, for each digit of the keys with a group's (column, prefix)."""
    rest = 64 - BITS * (depth + 1)
    wanted: dict[int, list[tuple[int, int]]] = {}
    for g, (column, prefix) in enumerate(groups):
        wanted.setdefault(column, []).append((g, prefix))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(groups), 1 << BITS), np.int64)
        low, high = np.full_like(n, np.iinfo(np.uint64).max, np.uint64), np.zeros_like(n, np.uint64)
        for batch in batches:
            for place, column in enumerate(wanted):
                part = np.sort(keys_of(np.asarray(batch.column(place).drop_null(), np.float64)))
                for g, prefix in wanted[column]:
                    keys = part
                    if depth:
                        shift = np.uint64(rest + BITS)
                        a, b = np.searchsorted(part >> shift, [np.uint64(prefix), np.uint64(prefix + 1)])
                        keys = part[a:b]
                    if not len(keys):
                        continue
                    digit = ((keys >> np.uint64(rest)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    first = np.flatnonzero(np.r_[True, digit[1:] != digit[:-1]])
                    last = np.r_[first[1:], len(digit)] - 1
                    d = digit[first]
                    n[g, d] += last - first + 1
                    low[g, d] = np.minimum(low[g, d], keys[first])
                    high[g, d] = np.maximum(high[g, d], keys[last])
        g, d = np.nonzero(n)
        signed = lambda k: (k[g, d] ^ _SIGN).view(np.int64)
        arrays = [pa.array(g, pa.int32()), pa.array(d, pa.int32()), pa.array(n[g, d]), pa.array(signed(low)), pa.array(signed(high))]
        yield pa.RecordBatch.from_arrays(arrays, ["grp", "digit", "n", "low", "high"])

    counts = values.select(*[f"v{c}" for c in wanted]).mapInArrow(count, _COUNTS)
    return counts.groupBy("grp", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _select(values: DataFrame, probabilities: list[float]) -> dict[tuple[int, int], float]:
    """``{(column, place of the probability): quantile}`` for the columns that have values."""
    # A search: (column, probability, 0 for the lower and 1 for the upper neighbour) -> prefix of the key, rank within it.
    searches = {(i, p, side): (0, None) for i in range(len(values.columns)) for p in range(len(probabilities)) for side in (0, 1)}
    spark, keys, totals = values.sparkSession, {}, {}
    for depth in range(PASSES):
        groups = sorted({(i, prefix) for (i, _, _), (prefix, _) in searches.items()})
        hits = {}
        for at in range(0, len(groups), TABLES):
            some = groups[at : at + TABLES]
            number = {g: k for k, g in enumerate(some)}
            asked = [
                (number[i, prefix], i, p, side, probabilities[p], rank)
                for (i, p, side), (prefix, rank) in searches.items()
                if (i, prefix) in number
            ]
            asked = spark.createDataFrame(asked, "grp int, i int, p int, side int, probability double, rank bigint")
            group = W.partitionBy("grp")
            upto = F.sum("n").over(group.orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
            ranked = _histograms(values, some, depth).select("*", upto.alias("upto"), F.sum("n").over(group).alias("total"))
            place = (F.col("total") - 1) * F.col("probability")
            rank = F.coalesce("rank", F.when(F.col("side") == 0, F.floor(place)).otherwise(F.ceil(place)))
            found = ranked.join(F.broadcast(asked), "grp").withColumn("rank", rank)
            found = found.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
            for r in found.collect():  # one row for each search
                hits[r["i"], r["p"], r["side"]] = r
                totals.setdefault(r["i"], r["total"])
        searches = {}
        for search, r in hits.items():
            if r["low"] == r["high"]:
                keys[search] = r["low"] + (1 << 63)
            else:
                prefix = (r["low"] + (1 << 63)) >> (64 - BITS * (depth + 1))
                searches[search] = (prefix, r["rank"] - (r["upto"] - r["n"]))
        if not searches:
            break
    result = {}
    for i, n in totals.items():
        for p, probability in enumerate(probabilities):
            lower, upper = (value_of(keys[i, p, side]) for side in (0, 1))
            place = (n - 1) * probability
            result[i, p] = lower if lower == upper else lower + (upper - lower) * (place - floor(place))
    return result


def iqr_bounds(
    df: DataFrame, columns: list[str], factor: float = 1.5, method: str = "exact"
) -> dict[str, tuple[float, float]]:
    """Outlier fences per column; columns without spread (or values) are left out."""
    fences = {}
    for name, (q1, q3) in quantiles(df, columns, [0.25, 0.75], method).items():
        if q1 is not None and q3 - q1 > 0:
            fences[name] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return fences
