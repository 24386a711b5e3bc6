"""Joining a table to one value per key without a hot key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import col

# A lookup table is broadcast only when it is proven to have at most this many rows.
BROADCAST_ROWS = 100_000
# Keys with more than 1/HOT_PARTS of all rows are hot; there are fewer than HOT_PARTS.
HOT_PARTS = 10_000
SALTS = 1_000


def local_copy(df: DataFrame, limit: int) -> DataFrame | None:
    """``df`` as a local table when it has at most ``limit`` rows, else None."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def attach_share(df: DataFrame, key: str, out: str, fit: DataFrame | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``out`` = share of the rows of ``fit`` (default ``df``) with the row's ``key``.

    Null is a key like any other. The counts are broadcast when few. When they are not,
    hot keys are broadcast and only the cold rest is joined by shuffle; rows already
    served get a salt, so that no shuffle partition holds a hot key.
    """
    fit = df if fit is None else fit
    counts = fit.groupBy(col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    small = local_copy(counts, limit)
    if small is not None:
        total = sum(r["__n"] for r in small.collect())
        table = small.select("__k", (F.col("__n") / F.lit(float(max(total, 1)))).alias(out))
        return df.join(F.broadcast(table), col(key).eqNullSafe(F.col("__k")), "left").drop("__k")

    total = float(fit.count())
    share = (F.col("__n") / F.lit(total)).alias("__share")
    is_hot = F.col("__n") > F.lit(total / HOT_PARTS)
    hot = local_copy(counts.filter(is_hot), HOT_PARTS).select(F.col("__k").alias("__hk"), share.alias("__hot"))
    cold = counts.filter(~is_hot).select(
        F.col("__k").alias("__ck"), F.lit(0).cast("bigint").alias("__cs"), share.alias("__cold")
    )
    marked = df.join(F.broadcast(hot), col(key).eqNullSafe(F.col("__hk")), "left").drop("__hk")
    served = F.col("__hot").isNotNull()
    marked = marked.withColumns(
        {
            "__jk": F.when(~served, col(key)),
            "__js": F.when(served, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + 1).otherwise(0),
        }
    )
    joined = marked.join(
        cold, F.col("__jk").eqNullSafe(F.col("__ck")) & F.col("__js").eqNullSafe(F.col("__cs")), "left"
    )
    return joined.withColumn(out, F.coalesce("__hot", "__cold")).drop("__jk", "__js", "__ck", "__cs", "__hot", "__cold")
