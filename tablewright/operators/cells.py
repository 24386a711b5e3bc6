"""Metric cells: the shared ground of the neighbour, density and silhouette jobs.

Points are assigned to the nearest of a bounded number of pivots. By the triangle
inequality a point can have a neighbour within r in a cell only if its distance to
the pivot is at most r plus the cell's radius, so whole cells are skipped exactly.
Cells that lie together form shards of bounded size (large cells are cut over several),
and the queries that visit a shard form blocks of bounded size. A shard meets a block
in one task (a tile) as two numpy matrices, whose cells are met one by one, so a query
is sent once for a shard and not for each cell; what leaves the tile is a short record
per query, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest_text

TILE_ROWS = 4_096  # rows on either side of a tile, at least while there are tiles for all cores
SIDE_ROWS, SIDE_VALUES = 1 << 16, 1 << 22  # rows, and values (rows x dimensions), on either side of a tile, at most
TILES = 32  # tiles that a join is cut into when it has rows enough
STRIP, PIECE = 1 << 20, 4_096  # pairs, and points, that a kernel looks at together
MAX_PIVOTS = 1_024  # pivots travel to every task: MAX_PIVOTS x dimensions doubles
ROWS_PER_PIVOT = 2_000
SLACK = 1e-9  # room for rounding in distance bounds


def as_array(df: DataFrame, name: str) -> Column:
    """A vector or array column as array<double>."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name).cast("array<double>")
    return vector_to_array(F.col(name))


def as_stored(df: DataFrame, name: str) -> Column:
    """The same, but floats stay floats, for they move at half the size; ``matrix`` makes them doubles."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        return F.col(name)
    return as_array(df, name)


def vector_key(vector: Column) -> Column:
    """A short key that only equal vectors share."""
    return digest_text(F.transform(vector, lambda x: x + 0.0))


def matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def rough_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by matrix product around a common centre, and how far off they can be."""
    centre = b.mean(axis=0)
    far = max(float(np.abs(a).max()), float(np.abs(b).max()))
    a, b = a - centre, b - centre
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    squares = a @ b.T
    squares *= -2.0
    squares += na[:, None]
    squares += nb[None, :]
    scale, dims = float(na.max()) + float(nb.max()), a.shape[1]
    return squares, 1e-14 * (dims + 8) * scale + 1e-15 * far * (dims * scale) ** 0.5


def exact_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of the listed pairs, from the differences, which keeps all digits."""
    out = np.empty(len(rows))
    step = max(1, 4_000_000 // a.shape[1])
    for i in range(0, len(rows), step):
        gap = a[rows[i : i + step]] - b[cols[i : i + step]]
        out[i : i + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def within_radius(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Which pairs are at most ``radius`` apart: single precision tells most, doubtful ones are measured exactly."""
    centre = b.mean(axis=0)
    near, doubt = None, 0
    x, y = a - centre, b - centre
    nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    scale = float(nx.max()) + float(ny.max())
    far = max(float(np.abs(a).max()), float(np.abs(b).max()))
    if 1e-30 < scale < 1e30:
        squares = x.astype(np.float32) @ y.T.astype(np.float32)
        squares *= np.float32(-2)
        squares += nx.astype(np.float32)[:, None]
        squares += ny.astype(np.float32)[None, :]
        error = 2.5e-7 * (a.shape[1] + 8) * scale + 1e-15 * far * (a.shape[1] * scale) ** 0.5
        near = squares <= np.nextafter(np.float32(radius * radius - error), np.float32(-np.inf))
        maybe = squares <= np.nextafter(np.float32(radius * radius + error), np.float32(np.inf))
        doubt = np.count_nonzero(maybe) - np.count_nonzero(near)
    if near is None or doubt * 64 > near.size:
        squares, error = rough_squares(a, b)
        near, maybe = squares <= radius * radius - error, squares <= radius * radius + error
        doubt = np.count_nonzero(maybe) - np.count_nonzero(near)
    if doubt:
        rows, cols = np.nonzero(maybe & ~near)
        near[rows, cols] = exact_distances(a, b, rows, cols) <= radius
    return near


def bound_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances right to within SLACK; pairs too close for the matrix product are measured exactly."""
    squares, error = rough_squares(a, b)
    close = squares <= error / SLACK
    rows, cols = np.nonzero(close) if close.any() else ((), ())
    out = np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)
    if len(rows):
        out[rows, cols] = exact_distances(a, b, rows, cols)
    return out


@dataclass
class Cells:
    """Pivots and, per cell number, radius and row count.

    A cell number is ``group * len(pivots) + pivot``; group 0 is everything, other
    groups are sets of points that some queries can leave out.
    """

    pivots: np.ndarray
    radius: dict[int, float]
    rows: dict[int, int]
    tile_rows: int = TILE_ROWS
    most: int = SIDE_ROWS

    @property
    def side_rows(self) -> int:
        """Rows of a shard or a block at most."""
        return max(min(self.most, SIDE_VALUES // max(self.pivots.shape[1], 1)), self.tile_rows)

    def shards(self) -> dict[int, tuple[int, int]]:
        """The first shard of each cell and over how many it is cut. Cells that lie together share a shard."""
        total = sum(self.rows.values())
        room = min(max(total // 8, self.tile_rows), self.side_rows)
        groups: dict[int, list[int]] = {}
        for cell in sorted(self.rows):
            groups.setdefault(cell % len(self.pivots), []).append(cell)
        used = np.array(sorted(groups))
        out, shard, held = {}, 0, 0
        for pivot in used[_together(self.pivots[used])]:
            for cell in groups[int(pivot)]:
                n = self.rows[cell]
                if held and held + n > room:
                    shard, held = shard + 1, 0
                parts = max(1, -(-n // room))
                out[cell] = (shard, parts)
                held += n
                if parts > 1:
                    shard, held = shard + parts, 0
        return out


def _together(points: np.ndarray) -> np.ndarray:
    """An order in which near points are mostly near: halves by the widest axis, again and again."""
    def halves(index: np.ndarray) -> list[np.ndarray]:
        if len(index) < 3:
            return [index]
        axis = int(np.ptp(points[index], axis=0).argmax())
        index = index[np.argsort(points[index, axis], kind="stable")]
        return halves(index[: len(index) // 2]) + halves(index[len(index) // 2 :])

    return np.concatenate(halves(np.arange(len(points))))


def choose_pivots(points: DataFrame, wanted: int) -> np.ndarray:
    """Up to ``wanted`` of the vectors ``v``, those with the smallest hashes.

    Which vectors serve as pivots affects speed only.
    """
    rows = points.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=np.float64), axis=0)


def pivot_count(rows: int) -> int:
    return int(min(MAX_PIVOTS, max(1, rows // ROWS_PER_PIVOT)))


def assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``reach``, the distance to its pivot. ``grp`` is used if present."""
    total = len(pivots)

    @F.pandas_udf("cell int, reach double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        v = matrix(vectors)
        gaps = bound_distances(v, pivots)
        cell = gaps.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "reach": gaps[np.arange(len(cell)), cell]})

    near = points.withColumn("_near", nearest("v"))
    offset = F.col("grp") * total if "grp" in points.columns else F.lit(0)
    return near.withColumns({"cell": (F.col("_near.cell") + offset).cast("int"), "reach": F.col("_near.reach")}).drop("_near")


def build_cells(assigned: DataFrame, pivots: np.ndarray, tile_rows: int = TILE_ROWS) -> Cells:
    stats = assigned.groupBy("cell").agg(F.max("reach").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    return Cells(pivots, {r["cell"]: r["r"] for r in stats}, {r["cell"]: r["n"] for r in stats}, tile_rows)


@dataclass
class _Reach:
    """Which cells a query has to meet."""

    numbers: np.ndarray
    pivots: np.ndarray
    radius: np.ndarray
    total: int
    others_only: bool
    only_own: bool

    def meets(self, v: np.ndarray, limit: np.ndarray, own: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Queries x cells (those at the places ``only``): may the cell hold a point no farther than ``limit``?"""
        at = np.arange(len(self.numbers)) if only is None else only
        numbers, mine = self.numbers[at][None, :], own.astype(np.int64)[:, None]
        if self.only_own:
            return numbers == mine
        gaps = bound_distances(v, self.pivots[at])
        out = gaps <= (limit[:, None] + self.radius[at][None, :]) * (1 + SLACK) + SLACK
        # A query of a group above 0 has no business with its own group.
        out &= (mine < self.total) | (numbers // self.total != mine // self.total)
        if self.others_only:
            out &= numbers != mine
        return out


#: Index arrays of queries and points that meet, strip by strip.
Strips = Iterator[tuple[np.ndarray, np.ndarray]]


def tile_join(
    queries: DataFrame,
    points: DataFrame,
    cells: Cells,
    kernel: Callable[[np.ndarray, pd.DataFrame, np.ndarray, pd.DataFrame, Strips], pd.DataFrame],
    schema: str,
    within: Column,
    others_only: bool = False,
    only_own: bool = False,
) -> DataFrame:
    """Run ``kernel(vectors and rows of a block, vectors and rows of a shard, strips)`` for all tiles that matter.

    Both sides are ``assigned`` and carry ``id`` and ``v``; queries also get ``reach_``, how far they look. Over all strips
    of all tiles each query meets each point of each cell within reach exactly once.
    """
    spark = queries.sparkSession
    if not cells.rows:
        return spark.createDataFrame([], schema)
    numbers = np.array(sorted(cells.rows), dtype=np.int64)
    total = len(cells.pivots)
    radius = np.array([cells.radius[int(c)] for c in numbers])
    reach = _Reach(numbers, cells.pivots[numbers % total], radius, total, others_only, only_own)
    plan = cells.shards()
    first, parts = (np.array([plan[int(c)][k] for c in numbers], dtype=np.int64) for k in (0, 1))
    shards = int((first + parts).max())

    @F.pandas_udf("array<int>")
    def reachable(vectors: pd.Series, limit: pd.Series, own: pd.Series) -> pd.Series:
        meets = reach.meets(matrix(vectors), limit.to_numpy(dtype=float), own.to_numpy())
        found = np.zeros((len(meets), shards + 1), np.int64)  # +1 where a cell's shards begin, -1 behind them
        for k in range(len(numbers)):
            found[:, first[k]] += meets[:, k]
            found[:, first[k] + parts[k]] -= meets[:, k]
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in np.cumsum(found[:, :-1], axis=1)])

    asked = queries.withColumn("reach_", within.cast("double"))
    visits = asked.withColumn("shard", F.explode(reachable("v", "reach_", "cell")))
    points = points.toDF(*points.columns)  # new column identities: both sides may be one table
    # Visits per shard decide into how many blocks its queries are cut.
    load = {r["shard"]: r["n"] for r in visits.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not load:
        return spark.createDataFrame([], schema)
    wanted = -(-TILES // len(load))
    blocks = {s: max(-(-n // cells.side_rows), min(wanted, -(-n // cells.tile_rows))) for s, n in load.items()}
    cut = F.broadcast(spark.createDataFrame(list(blocks.items()), "shard int, blocks int"))  # one line per shard
    places = spark.createDataFrame([(int(c), *map(int, x)) for c, x in plan.items()], "cell int, first int, parts int")
    left = visits.join(cut, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    right = (
        points.join(F.broadcast(places), "cell")  # one line per cell
        .withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts"))).cast("int"))
        .drop("first", "parts")
        .join(cut, "shard")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .drop("blocks")
    )
    keys = ["shard", "block"]
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def tile(block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(shard):
            return pd.DataFrame({n: [] for n in names})
        a, b = matrix(block.pop("v")), matrix(shard.pop("v"))
        here, cell = np.unique(shard["cell"].to_numpy(), return_inverse=True)
        meets = reach.meets(a, block["reach_"].to_numpy(dtype=float), block["cell"].to_numpy(), np.searchsorted(numbers, here))

        def strips() -> Strips:
            for k in range(len(here)):
                rows, cols = np.flatnonzero(meets[:, k]), np.flatnonzero(cell == k)
                for j in range(0, len(cols), PIECE):
                    piece = cols[j : j + PIECE]
                    step = max(1, STRIP // len(piece))
                    for i in range(0, len(rows), step):
                        yield rows[i : i + step], piece

        return kernel(a, block, b, shard, strips())

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, schema)
