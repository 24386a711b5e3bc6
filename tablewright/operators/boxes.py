"""Boxes of points: the ground of the neighbour search.

A tree of halves over a bounded sample deals points to parts. Each part has a box, and a ball, around its points, so that a query passes by all
parts that hold no point within its limit. A part meets a block of the queries that visit it in one task, where the points are halved on to small leaves, and
each leaf meets just the queries within whose limit its box is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import SIDE_VALUES, SLACK, TILES, bound_distances, exact_distances, matrix, rough_squares

#: Rows of a part, and values (rows x dimensions) of the sample whose halves make the parts, at most.
PART_ROWS, SAMPLE_VALUES = 1 << 15, 1 << 21
#: Rows of the sample for each part, and rows that choose an axis.
PART_SAMPLE, AXIS_ROWS = 64, 256
#: Points of a leaf, and queries of a group with the leaves that give it a first bound.
LEAF_ROWS, GROUP_ROWS, FIRST_LEAVES = 64, 64, 16
#: Pairs that are held, besides some for each query, before they are cut to the nearest.
HELD = 1 << 20
#: What a gap between two halves counts against the way to the other half.
GAP = 10.0
#: Distances from queries to boxes that are looked at together, and that stay in a cache.
STRIP, CACHED = 1 << 19, 1 << 14


def half(x: np.ndarray) -> tuple[int, float] | None:
    """The axis and the cut (rows above go right) by which two halves are far apart for most pairs; none for a sample of equal rows."""
    t = np.sort(x[:: -(-len(x) // AXIS_ROWS)], axis=0)
    middle = t[len(t) // 2]
    left = t < middle
    left |= (t <= middle) & ~left.any(axis=0)
    n = left.sum(axis=0)
    inner = np.flatnonzero((n > 0) & (n < len(t)))
    if not len(inner):
        return None
    t, left, n = t[:, inner], left[:, inner], n[inner]
    at = np.arange(len(inner))
    low, high = t[n - 1, at], t[n, at]
    way = np.square(np.where(left, high - t, t - low)).mean(axis=0)
    f = int((n * (len(t) - n) * (way + GAP * np.square(high - low))).argmax())
    cut = low[f] / 2 + high[f] / 2
    return int(inner[f]), float(cut if low[f] <= cut < high[f] else low[f])


def leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows in lists of at most ``most`` that lie together."""
    out, waiting = [], [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        found = half(x[rows])
        if found is None:  # rows that are mostly equal, in any order
            waiting += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        else:
            right = x[rows, found[0]] > found[1]
            waiting += [rows[right], rows[~right]]
    return out


def around(x: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values of each list of rows."""
    order, start = np.concatenate(lists), np.cumsum([0, *map(len, lists[:-1])])
    return np.fmin.reduceat(x[order], start), np.fmax.reduceat(x[order], start)


def box_squares(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances (rows x boxes) to the nearest places of boxes."""
    out = np.zeros((len(a), len(low)))
    low, high, step = np.ascontiguousarray(low.T), np.ascontiguousarray(high.T), max(1, CACHED // len(low))
    held = np.empty((step, out.shape[1]))
    for at in range(0, len(a), step):
        to = out[at : at + step]
        gap = held[: len(to)]
        for v, least, most in zip(a[at : at + step].T, low, high):
            np.clip(v[:, None], least, most, out=gap)
            gap -= v[:, None]
            gap *= gap
            to += gap
    return out


def _wider(squares: np.ndarray) -> np.ndarray:
    return squares * (1 + SLACK) + SLACK**2


def _first_bounds(a: np.ndarray, b: np.ndarray, lists: list[np.ndarray], low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of the squared k-th distances, from the leaves that are nearest to groups of rows."""
    bound = np.full(len(a), np.inf)
    for rows in leaves(a, GROUP_ROWS):
        x = a[rows]
        gap = np.fmax(np.fmax(low - np.fmax.reduce(x), np.fmin.reduce(x) - high), 0.0)
        near = np.argsort(np.einsum("ij,ij->i", gap, gap), kind="stable")[:FIRST_LEAVES]
        cols = np.concatenate([lists[n] for n in near.tolist()])
        if len(cols) >= k:
            squares, error = rough_squares(x, b[cols])
            bound[rows] = np.maximum(np.partition(squares, k - 1, axis=1)[:, k - 1] + error, 0.0)
    return bound


def _firsts(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers start, and how long they are."""
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
    return first, np.diff(np.r_[first, len(i)])


def nearest(a: np.ndarray, limit: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of a, row of b, distance)``: for each row of ``a`` its ``k`` nearest in ``b`` and those as far as the last, none far beyond ``limit``."""
    lists = leaves(b, LEAF_ROWS)
    low, high = around(b, lists)
    bound = _wider(np.square(limit))
    unknown = np.flatnonzero(np.isinf(bound))
    if len(unknown):
        bound[unknown] = _wider(_first_bounds(a[unknown], b, lists, low, high, k))
    meets = np.empty((len(a), len(lists)), bool)
    for at in range(0, len(a), step := max(1, STRIP // len(lists))):
        meets[at : at + step] = box_squares(a[at : at + step], low, high) <= _wider(bound[at : at + step])[:, None]
    i, j, held, off = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0.0
    new, count, most = [], 0, HELD + 4 * k * len(a)

    def shortened() -> None:
        """Drops what is farther than k others: no pair is farther than it is held to be."""
        nonlocal i, j, held, new, count
        i, j, held = (np.concatenate(c) for c in zip((i, j, held), *new))
        new, count = [], 0
        by = np.lexsort((held, i))
        i, j, held = i[by], j[by], held[by]
        first, size = _firsts(i)
        first = first[size >= k]
        bound[i[first]] = np.minimum(bound[i[first]], _wider(np.maximum(held[first + k - 1], 0.0)))
        keep = held <= bound[i] + 2 * off
        i, j, held = i[keep], j[keep], held[keep]

    for n, cols in enumerate(lists):
        rows = np.flatnonzero(meets[:, n])
        if not len(rows):
            continue
        squares, error = rough_squares(a[rows], b[cols])
        off = max(off, error)
        r, c = np.nonzero(squares <= (bound[rows] + error)[:, None])
        if len(r):
            new.append((rows[r], cols[c], squares[r, c] + error))
            count += len(r)
            if count > most:
                shortened()
    shortened()
    distance = exact_distances(a, b, i, j)
    # Equal distances are settled later by point id, so all of the k-th rank stay.
    by = np.lexsort((distance, i))
    i, j, distance = i[by], j[by], distance[by]
    first, size = _firsts(i)
    keep = distance <= np.repeat(distance[np.minimum(first + k, first + size) - 1], size) if len(i) else np.zeros(0, bool)
    return i[keep], j[keep], distance[keep]


@dataclass
class Halves:
    """A tree of halves: ``part`` numbers its leaves."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    part: np.ndarray
    centres: np.ndarray

    def parts(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[self.feature[node[rows]] >= 0]):
            here = node[rows]
            node[rows] = self.child[here] + (x[rows, self.feature[here]] > self.cut[here])
        return self.part[node]


def halves(sample: np.ndarray, parts: int) -> Halves:
    """Halves of a sample down to about its share of a part."""
    most = max(-(-len(sample) // parts), 1)
    feature, cut, child, part, centres, waiting = [-1], [0.0], [-1], [-1], [], [(0, np.arange(len(sample)))]
    while waiting:
        node, rows = waiting.pop()
        found = half(sample[rows]) if len(rows) > most else None
        if found is None:
            part[node] = len(centres)
            centres.append(sample[rows].mean(axis=0))
            continue
        feature[node], cut[node], child[node] = *found, len(feature)
        right = sample[rows, found[0]] > found[1]
        waiting += [(child[node] + 1, rows[right]), (child[node], rows[~right])]
        for column, v in ((feature, -1), (cut, 0.0), (child, -1), (part, -1)):
            column += [v, v]
    return Halves(*map(np.array, (feature, cut, child, part, centres)))


@dataclass
class Parts:
    """What queries have to know of the parts."""

    tree: Halves
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    most: int  # rows of a shard

    def meets(self, v: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Queries x parts: may the part hold a point no farther than ``limit``?"""
        near = box_squares(v, self.low, self.high) <= _wider(np.square(limit))[:, None]
        return near & (bound_distances(v, self.tree.centres) <= (limit[:, None] + self.radius) * (1 + SLACK) + SLACK)

    def bound(self, v: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the k-th distance from boxes and counts alone."""
        far = np.zeros((len(v), len(self.rows)))
        for f in range(v.shape[1]):
            far += np.square(np.fmax(np.abs(v[:, f, None] - self.low[None, :, f]), np.abs(v[:, f, None] - self.high[None, :, f])))
        order = far.argsort(axis=1)
        enough = self.rows[order].cumsum(axis=1) >= k
        reach = np.take_along_axis(far, order, axis=1)[np.arange(len(v)), enough.argmax(axis=1)]
        return np.where(enough.any(axis=1), np.sqrt(reach) * (1 + SLACK), np.inf)


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def build_parts(points: DataFrame, sample: np.ndarray, parts: int, most: int) -> tuple[DataFrame, Parts]:
    """``points`` (``id``, ``v``) with the number of their part, and the parts."""
    tree = halves(sample, parts)
    count, width = len(tree.centres), sample.shape[1]

    @F.pandas_udf("int")
    def part(vectors: pd.Series) -> pd.Series:
        return pd.Series(tree.parts(matrix(vectors)), dtype="int32")

    placed = points.withColumn("part", part("v"))
    schema, binary = "part int, n bigint, low binary, high binary, radius double", pa.binary()

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((count, width), np.inf), np.full((count, width), -np.inf)
        n, radius = np.zeros(count, np.int64), np.zeros(count)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, at = _flat(batch.column("v")), np.asarray(batch.column("part"), np.int64)
            by = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, at[by][1:] != at[by][:-1]])
            here, x = at[by][first], x[by]
            low[here], high[here] = np.fmin(low[here], np.fmin.reduceat(x, first)), np.fmax(high[here], np.fmax.reduceat(x, first))
            gap = np.sqrt(np.square(x - tree.centres[at[by]]).sum(axis=1))
            radius[here], n = np.maximum(radius[here], np.maximum.reduceat(gap, first)), n + np.bincount(at, minlength=count)
        here = np.flatnonzero(n)
        columns = [pa.array(here, pa.int32()), pa.array(n[here]), *(pa.array([v.tobytes() for v in e[here]], binary) for e in (low, high)), pa.array(radius[here])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "n", "low", "high", "radius"])

    def merged(table: pa.Table) -> pa.Table:
        low, high = (g([np.frombuffer(v) for v in table.column(c).to_pylist()], axis=0) for c, g in (("low", np.min), ("high", np.max)))
        n, radius = sum(table.column("n").to_pylist()), max(table.column("radius").to_pylist())
        columns = [table.column("part").slice(0, 1), pa.array([n]), pa.array([low.tobytes()], binary), pa.array([high.tobytes()], binary), pa.array([radius])]
        return pa.table(columns, ["part", "n", "low", "high", "radius"])

    rows = np.zeros(count, np.int64)
    low, high, radius = np.full((count, width), np.inf), np.full((count, width), -np.inf), np.zeros(count)
    # A short line for each part.
    for r in placed.select("v", "part").mapInArrow(stats, schema).groupBy("part").applyInArrow(merged, schema).collect():
        rows[r["part"]], low[r["part"]], high[r["part"]], radius[r["part"]] = r["n"], np.frombuffer(r["low"]), np.frombuffer(r["high"]), r["radius"]
    return placed, Parts(tree, low, high, radius, rows, most)


def side_rows(width: int, tile_rows: int) -> int:
    """Rows of a shard or a block at most."""
    return max(min(PART_ROWS, SIDE_VALUES // max(width, 1)), tile_rows)


def box_join(queries: DataFrame, points: DataFrame, parts: Parts, k: int, tile_rows: int, limit: Column | None = None) -> DataFrame:
    """``(qkey, key, distance)``: the nearest points in the part that each query falls in, or with ``limit`` in all other parts within it.

    ``limit`` is how far a query looks, null where that is unknown.
    """
    spark, tree = queries.sparkSession, parts.tree
    pieces = np.maximum(-(-parts.rows // (2 * parts.most)), 1)  # a part that came out too large is cut
    first = np.cumsum(pieces) - pieces
    own_only = limit is None

    @F.pandas_udf("struct<limit double, shards array<int>>")
    def visits(vectors: pd.Series, limits: pd.Series) -> pd.DataFrame:
        v, far = matrix(vectors), limits.to_numpy(dtype=float).copy()
        own, found = tree.parts(v), []
        for i in range(0, len(v), step := max(1, STRIP // len(pieces))):
            x, mine, here = v[i : i + step], own[i : i + step], far[i : i + step]
            if own_only:
                meets = np.zeros((len(x), len(pieces)), bool)
                meets[np.arange(len(x)), mine] = True
                here[:] = np.inf
            else:
                unknown = np.isnan(here)
                if unknown.any():
                    here[unknown] = parts.bound(x[unknown], k)
                meets = parts.meets(x, here)
                meets[np.arange(len(x)), mine] = False
            found += [np.concatenate([np.arange(first[p], first[p] + pieces[p]) for p in np.flatnonzero(row)] or [[]]).astype(np.int32) for row in meets]
        return pd.DataFrame({"limit": far, "shards": found})

    wanted = (F.lit(None) if own_only else limit).cast("double")
    asked = queries.withColumn("visit", visits("v", wanted)).select("id", "v", "visit.limit", F.explode("visit.shards").alias("shard"))
    load = {r["shard"]: r["n"] for r in asked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each shard
    schema = "qkey string, key string, distance double"
    if not load:
        return spark.createDataFrame([], schema)
    side, share = max(parts.most, tile_rows), -(-TILES // len(load))
    blocks = {s: max(-(-n // side), min(share, -(-n // tile_rows))) for s, n in load.items()}
    cut = F.broadcast(spark.createDataFrame(list(blocks.items()), "shard int, blocks int"))  # one line for each shard
    places = spark.createDataFrame([(p, int(first[p]), int(n)) for p, n in enumerate(pieces)], "part int, first int, pieces int")
    left = asked.join(cut, "shard").select("id", "v", "limit", "shard", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    points = points.toDF(*points.columns)  # new column identities: both sides may be one table
    shard = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces"))).cast("int")
    right = (
        points.join(F.broadcast(places), "part")  # one line for each part
        .select("id", "v", shard.alias("shard"))
        .join(cut, "shard")
        .select("id", "v", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )

    def tile(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            i, j, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            i, j, distance = nearest(_flat(asked.column("v")), np.array(asked.column("limit"), np.float64), _flat(held.column("v")), k)
        return pa.table([asked.column("id").take(pa.array(i)).cast(pa.string()), held.column("id").take(pa.array(j)).cast(pa.string()), pa.array(distance)], ["qkey", "key", "distance"])

    keys = ["shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, schema)
