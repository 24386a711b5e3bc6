"""Quality of a clustering: silhouette, Davies-Bouldin, Calinski-Harabasz."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cells import (
    SIDE_ROWS,
    SIDE_VALUES,
    TILE_ROWS,
    Strips,
    as_array,
    as_stored,
    assign,
    bound_distances,
    build_cells,
    choose_pivots,
    matrix,
    tile_join,
    vector_key,
)
from .lookup import local_copy

# Centroids are broadcast when there are at most this many numbers in them.
BROADCAST_VALUES = 2_000_000


def _points(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    return df.select(F.col(cluster).cast("bigint").alias("c"), as_array(df, vector).alias("v"))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def centroids(points: DataFrame) -> DataFrame:
    """``(c, n, centre)``; means are merged before the shuffle."""
    means = points.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector("v")).alias("m")
    )
    return means.select("c", "n", vector_to_array("m").alias("centre"))


def _spread(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``(c, n, centre, s, w)``: mean distance and sum of squared distances to the centre."""
    dims = points.limit(1).select(F.size("v").alias("d")).first()
    limit = BROADCAST_VALUES // max(dims["d"] if dims else 1, 1)
    small = local_copy(centres, limit)
    side = F.broadcast(small) if small is not None else centres
    gap = points.join(side, "c").withColumn("g", euclidean(F.col("v"), F.col("centre")))
    sums = gap.groupBy("c").agg(F.avg("g").alias("s"), F.sum(F.col("g") * F.col("g")).alias("w"))
    return (small if small is not None else centres).join(sums, "c")


def davies_bouldin(df: DataFrame, vector: str = "features", cluster: str = "prediction") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij; null with one cluster.

    Centres meet in tiles of bounded size, each giving one maximum per cluster.
    """
    points = _points(df, vector, cluster)
    spread = cut_lineage(_spread(points, centroids(points)), "centres")
    k = spread.count()
    blocks = -(-k // TILE_ROWS) or 1
    number = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = spread.withColumns({"i": number, "j": every})
    right = spread.withColumns({"j": number, "i": every})

    def worst(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"c": [], "r": []})
        x, y = matrix(a["centre"]), matrix(b["centre"])
        out = np.zeros(len(a))
        for i in range(len(a)):
            gap = np.sqrt(((y - x[i]) ** 2).sum(axis=1))
            both = a["s"].to_numpy()[i] + b["s"].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(gap > 0, both / gap, np.where(both > 0, np.inf, 0.0))
            ratio[b["c"].to_numpy() == a["c"].to_numpy()[i]] = 0.0
            out[i] = ratio.max()
        return pd.DataFrame({"c": a["c"], "r": out})

    rows = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(worst, "c bigint, r double")
    per_cluster = rows.groupBy("c").agg(F.max("r").alias("r"))
    return per_cluster.agg(F.when(F.count(F.lit(1)) > 1, F.avg("r")).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, vector: str = "features", cluster: str = "prediction") -> DataFrame:
    """Between over within dispersion, each per degree of freedom; null with one cluster."""
    points = _points(df, vector, cluster)
    spread = cut_lineage(_spread(points, centroids(points)), "centres")
    weighted = Summarizer.mean(array_to_vector("centre"), F.col("n").cast("double"))
    overall = spread.agg(weighted.alias("m")).select(vector_to_array("m").alias("all"), F.lit(1).alias("one"))
    gap = euclidean(F.col("centre"), F.col("all"))
    # `overall` is one line.
    parts = spread.withColumn("one", F.lit(1)).join(F.broadcast(overall), "one").agg(
        F.sum(F.col("n") * gap * gap).alias("b"),
        F.sum("w").alias("w"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
    )
    value = F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1))
    # Without any spread inside clusters the index is 1 by definition.
    value = F.when(F.col("w") == 0, F.lit(1.0)).otherwise(value)
    return parts.select(F.when(F.col("k") > 1, value).alias("calinski_harabasz"))


def silhouette_squared(df: DataFrame, vector: str = "features", cluster: str = "prediction") -> float | None:
    """Mean silhouette with squared distances: one pass over the data, for any size."""
    points = _points(df, vector, cluster).select(
        array_to_vector("v").alias("features"), F.col("c").cast("double").alias("prediction")
    )
    if points.select("prediction").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator().evaluate(points)


def silhouette(
    df: DataFrame, vector: str = "features", cluster: str = "prediction", tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Mean silhouette with euclidean distances, exact; null with one cluster.

    Every point is compared with all others, in tiles that return one sum per point and
    cluster; distances come from matrix products and are right to within ``SLACK``. Equal points of a cluster are one weighted point. For large tables see
    ``silhouette_squared``.
    """
    points = df.select(F.col(cluster).cast("bigint").alias("c"), as_stored(df, vector).alias("v"))
    points = points.withColumn("key", vector_key(F.col("v")))
    merged = points.groupBy("c", "key").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).cast("double").alias("w"))
    merged = cut_lineage(merged.withColumn("id", F.concat_ws("|", "c", "key")), "silhouette")
    first = choose_pivots(merged, 1)
    placed = assign(merged, first)

    def sums(a: np.ndarray, block: pd.DataFrame, b: np.ndarray, shard: pd.DataFrame, strips: Strips) -> pd.DataFrame:
        weight, (kinds, index) = shard["w"].to_numpy(), np.unique(shard["c"].to_numpy(), return_inverse=True)
        total = np.zeros((len(a), len(kinds)))
        for rows, cols in strips:
            cols = cols[np.argsort(index[cols], kind="stable")]
            kind = index[cols]
            start = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
            far = bound_distances(a[rows], b[cols])
            far *= weight[cols]
            total[rows[:, None], kind[start][None, :]] += np.add.reduceat(far, start, axis=1)
        return pd.DataFrame(
            {
                "id": np.repeat(block["id"].to_numpy(), len(kinds)),
                "other": np.tile(kinds, len(a)),
                "far": total.ravel(),
            }
        )

    cells = build_cells(placed, first, tile_rows)
    # A tile holds a sum for each of its points and clusters.
    cells.most = min(SIDE_ROWS, SIDE_VALUES // max(merged.select("c").distinct().count(), 1))
    tiles = tile_join(
        placed.select("id", "v", "cell"),
        placed.select("id", "v", "cell", "c", "w"),
        cells,
        sums,
        "id string, other bigint, far double",
        F.lit(float("inf")),
    )
    totals = tiles.groupBy("id", "other").agg(F.sum("far").alias("far"))
    sizes = points.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    own = F.col("other") == F.col("c")
    apart = totals.join(sizes.withColumnRenamed("c", "other"), "other").join(merged.select("id", "c", "w"), "id")
    scored = apart.groupBy("id").agg(
        F.any_value("w").alias("w"),
        F.max(F.when(own, F.col("size"))).alias("own_size"),
        F.max(F.when(own, F.try_divide(F.col("far"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("far") / F.col("size"))).alias("b"),
    )
    score = F.when(F.col("own_size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    # With one cluster no point has a distance b.
    return scored.agg(
        F.when(F.count("b") > 0, F.try_divide(F.sum(score * F.col("w")), F.sum("w"))).alias("silhouette")
    )
