"""Density-based clustering (DBSCAN), exact, as tile joins and components.

1. Equal vectors merge into one weighted point.
2. Points in one small box of side eps/sqrt(d) are all within eps of each other. A box
   of weight min_samples or more is dense: its points are core and share a cluster,
   with no pair looked at. Dense boxes whose first points are within eps are joined;
   that settles the bulk of the data. Large settled groups become cells of their own,
   which their members never have to visit.
3. Remaining points: neighbour weights decide who is core.
4. Core points of different groups within eps join their groups. A tile returns a
   forest over the groups it has seen, not the pairs.
5. Other points join the smallest cluster with a core point within eps, or are noise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest_text
from ..session import cut_lineage
from .cells import (
    TILE_ROWS,
    Strips,
    as_stored,
    assign,
    build_cells,
    choose_pivots,
    pivot_count,
    tile_join,
    vector_key,
    within_radius,
)
from .components import connected_components

NOISE = -1
HOT_GROUPS = 64  # settled groups with cells of their own


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (of each node the smallest one known to be linked with it) after the links ``x``, ``y``."""
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def _link_kernel(eps: float):
    """Edges (node, smallest node of its component in the tile)."""

    def kernel(a: np.ndarray, block: pd.DataFrame, b: np.ndarray, shard: pd.DataFrame, strips: Strips) -> pd.DataFrame:
        left, right = block["node"].to_numpy(), shard["node"].to_numpy()
        nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
        li, ri = index[: len(left)], index[len(left) :]
        label = np.arange(len(nodes))
        for rows, cols in strips:
            i, j = np.nonzero(within_radius(a[rows], b[cols], eps))
            label = _join(label, li[rows[i]], ri[cols[j]])
        moved = label != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})

    return kernel


def _weight_kernel(eps: float):
    def kernel(a: np.ndarray, block: pd.DataFrame, b: np.ndarray, shard: pd.DataFrame, strips: Strips) -> pd.DataFrame:
        total, w = np.zeros(len(a)), shard["w"].to_numpy()
        for rows, cols in strips:
            near, own = within_radius(a[rows], b[cols], eps), w[cols]
            total[rows] += np.count_nonzero(near, axis=1) if (own == 1).all() else near @ own
        return pd.DataFrame({"id": block["id"].to_numpy(), "weight": total})

    return kernel


def _adopt_kernel(eps: float):
    def kernel(a: np.ndarray, block: pd.DataFrame, b: np.ndarray, shard: pd.DataFrame, strips: Strips) -> pd.DataFrame:
        top = np.iinfo(np.int64).max
        best, root = np.full(len(a), top), shard["root"].to_numpy()
        for rows, cols in strips:
            i, j = np.nonzero(within_radius(a[rows], b[cols], eps))
            np.minimum.at(best, rows[i], root[cols[j]])
        hit = best < top
        return pd.DataFrame({"id": block["id"].to_numpy()[hit], "root": best[hit]})

    return kernel


def dbscan(
    df: DataFrame,
    eps: float,
    min_samples: int,
    id_col: str = "id",
    vector: str = "features",
    tile_rows: int = TILE_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """``(id, cluster, is_core)``: cluster is its smallest core id, or -1 for noise.

    Ids are non-negative integers. A point counts as its own neighbour. A border point
    within reach of several clusters goes to the one with the smallest id.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    rows = df.select(F.col(id_col).cast("bigint").alias("rid"), as_stored(df, vector).alias("v"))
    rows = rows.withColumn("key", vector_key(F.col("v")))
    keyed = cut_lineage(
        rows.groupBy("key").agg(F.min("rid").alias("id"), F.count(F.lit(1)).cast("double").alias("w"), F.any_value("v").alias("v")),
        "density-points",
    )
    if keyed.isEmpty():
        raise ValueError("no points to cluster")
    dims = len(keyed.select("v").first()["v"])
    side = eps / dims**0.5 * (1 - 1e-6)
    box = digest_text(F.transform("v", lambda x: F.floor(x / F.lit(side))))
    points = keyed.withColumn("box", box)
    dense = (
        points.groupBy("box")
        .agg(F.sum("w").alias("bw"), F.min(F.struct("id", "v")).alias("first"))
        .filter(F.col("bw") >= min_samples)
        .select("box", F.col("first.id").alias("id"), F.col("first.v").alias("v"))
    )
    dense = cut_lineage(dense, "density-boxes")
    chosen = choose_pivots(keyed, pivots or pivot_count(keyed.count()))
    radius = F.lit(float(eps))
    links = "a bigint, b bigint"

    settled = dense.select("box", F.col("id").alias("node"))
    if not dense.isEmpty():
        firsts = cut_lineage(assign(dense.withColumn("node", F.col("id")), chosen), "density-firsts")
        near = tile_join(firsts, firsts, build_cells(firsts, chosen, tile_rows), _link_kernel(eps), links, radius)
        roots = connected_components(near)
        settled = dense.join(roots, dense["id"] == roots["node"], "left").select(
            "box", F.coalesce("root", "id").alias("node")
        )

    joined = points.join(settled, "box", "left").withColumnRenamed("node", "settled")
    joined = cut_lineage(joined, "density-settled")
    hot = (
        joined.filter(F.col("settled").isNotNull())
        .groupBy("settled")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > tile_rows)
        .orderBy(F.desc("n"), "settled")
        .limit(HOT_GROUPS)
        .collect()
    )
    hot_groups = [(r["settled"], i + 1) for i, r in enumerate(hot)]
    groups = df.sparkSession.createDataFrame(hot_groups, "settled bigint, grp int")
    grouped = joined.join(F.broadcast(groups), "settled", "left").withColumn("grp", F.coalesce("grp", F.lit(0)))
    placed = cut_lineage(assign(grouped.select("key", "id", "w", "v", "settled", "grp"), chosen), "density-placed")

    cells = build_cells(placed, chosen, tile_rows)
    loose = placed.filter(F.col("settled").isNull())
    weights = (
        tile_join(loose.select("id", "v", "cell"), placed.select("id", "v", "w", "cell"), cells, _weight_kernel(eps), "id bigint, weight double", radius)
        .groupBy("id")
        .agg(F.sum("weight").alias("weight"))
        .filter(F.col("weight") >= min_samples)
        .select("id", F.lit(True).alias("enough"))
    )
    known = cut_lineage(
        placed.join(weights, "id", "left")
        .withColumn("is_core", F.col("settled").isNotNull() | F.coalesce("enough", F.lit(False)))
        .withColumn("node", F.coalesce("settled", "id"))
        .drop("enough"),
        "density-core",
    )
    core = known.filter("is_core")
    if core.isEmpty():
        return rows.select(F.col("rid").alias(id_col), F.lit(NOISE).cast("bigint").alias("cluster"), F.lit(False).alias("is_core"))

    core_cells = build_cells(core, chosen, tile_rows)
    side_cols = ["id", "v", "node", "cell"]
    found = tile_join(core.select(side_cols), core.select(side_cols), core_cells, _link_kernel(eps), links, radius)
    roots = connected_components(found)
    # The root of a component is a node name; clusters are named by their smallest core id.
    rooted = core.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("id").alias("cluster"))
    rooted = cut_lineage(
        rooted.join(names, "root").select("id", "v", "cell", F.col("cluster").alias("root")), "density-rooted"
    )
    rest = known.filter("not is_core")
    adopted = (
        tile_join(rest.select("id", "v", "cell"), rooted, core_cells, _adopt_kernel(eps), "id bigint, root bigint", radius)
        .groupBy("id")
        .agg(F.min("root").alias("cluster"))
    )
    labels = (
        known.select("id", "key", "is_core")
        .join(rooted.select("id", F.col("root").alias("own")), "id", "left")
        .join(adopted, "id", "left")
        .select("key", "is_core", F.coalesce("own", "cluster", F.lit(NOISE)).alias("cluster"))
    )
    return rows.join(labels, "key").select(F.col("rid").alias(id_col), "cluster", "is_core")
