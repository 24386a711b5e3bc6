"""Sums of products of columns in one scan: correlations of all pairs, and linear models from normal equations.

Each task multiplies blocks of rows as matrices (values, squares and masks of what is present) and gives one short row for each pair
of columns; Spark adds them up. Values are shifted by one that lies among them first, against cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double

#: Rows in which a first value of each column is looked for.
SHIFT_ROWS = 1_000
#: Variance below this share of the mean square about the shift is rounding.
ROUNDING = 1e-13

_PAIRS = "x int, y int, n bigint, sx double, sy double, sxx double, syy double, sxy double"


def pair_sums(values: DataFrame, shift: list[float]) -> DataFrame:
    """For each pair ``x <= y`` of columns, over rows with both: count, sums, sums of squares and of products, of shifted values."""
    names = [f.split()[0] for f in _PAIRS.split(", ")]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(shift)
        n, s, q, p = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            columns = [np.asarray(c.fill_null(float("nan")), np.float64) for c in batch.columns]
            v = np.stack(columns, axis=1) - np.array(shift)
            here = ~np.isnan(v)
            v, mask = np.where(here, v, 0.0), here.astype(np.float64)
            n += mask.T @ mask
            s += v.T @ mask  # row x, column y: x summed where y is present
            q += (v * v).T @ mask
            p += v.T @ v
        x, y = np.triu_indices(width)
        columns = [x.astype(np.int32), y.astype(np.int32), n[x, y].astype(np.int64), s[x, y], s[y, x], q[x, y], q[y, x], p[x, y]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return values.mapInArrow(multiply, _PAIRS).groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in names[2:]])


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """``(x, y, corr)`` of all pairs of numeric columns, both orders: pairwise complete, null without variance."""
    values = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(names)])
    first = values.limit(SHIFT_ROWS).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values.columns]).first()
    shift = [v if v is not None and np.isfinite(v) else 0.0 for v in first]

    def spread(s: str, ss: str) -> F.Column:
        v = F.col(ss) - F.col(s) * F.col(s) / F.col("n")
        return F.when(v > F.col(ss) * ROUNDING, v)

    joint = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    corr = F.when(F.col("n") > 1, F.try_divide(joint, F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy"))))
    named = F.array(*[F.lit(c) for c in names])
    name = lambda c: F.element_at(named, F.col(c) + 1)
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y"))).otherwise(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    pairs = pair_sums(values, shift).select(corr.alias("corr"), F.explode(both).alias("pair"))
    return pairs.select(name("pair.x").alias("x"), name("pair.y").alias("y"), "corr")


class NormalEquations:
    """Centred products of features and label, from one scan; any number of penalties are solved from them."""

    def __init__(self, data: DataFrame, width: int) -> None:
        shift = np.zeros(width + 1)
        first = data.select(vector_to_array("features").alias("x"), F.col("label").cast("double")).first()
        if first is not None:
            shift = np.r_[np.array(first["x"]), first["label"]]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width + 2, width + 2))
            for batch in batches:
                x = np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, width)
                z = np.c_[x, np.asarray(batch.column("label"), np.float64)] - shift
                z = np.c_[z, np.ones(len(z))]
                total += z.T @ z
            i, j = np.triu_indices(width + 2)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

        rows = data.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        sums = rows.mapInArrow(multiply, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
        total = np.zeros((width + 2, width + 2))
        total[sums["i"], sums["j"]] = sums["s"]
        total = total + np.triu(total, 1).T
        self.rows = total[-1, -1]
        mean = total[-1, :-1] / max(self.rows, 1)
        centred = total[:-1, :-1] - self.rows * np.outer(mean, mean)
        self.products, self.target, self.mean = centred[:-1, :-1], centred[:-1, -1], mean + shift

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients and intercept that minimise squared error plus ``alpha`` times squared coefficients."""
        matrix = self.products + alpha * np.eye(len(self.target))
        slope = np.linalg.lstsq(matrix, self.target, rcond=None)[0] if alpha == 0 else np.linalg.solve(matrix, self.target)
        return slope, float(self.mean[-1] - self.mean[:-1] @ slope)
