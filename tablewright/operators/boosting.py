"""Boosted regression trees of small depth, as MLlib's: squared error, cuts at quantiles, each tree fitted to twice the residuals.

Rows are turned into places among the cuts once, packed into blocks of bytes. A level of a tree is one pass: tasks count a histogram of the
open nodes by feature and cut, and the sums choose the splits. The trees grown since the blocks were written are applied to the bytes on the way,
and every ``FOLDED`` rounds the residuals are written anew, so that a pass costs the same in each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard_files

#: Places of a feature (MLlib's ``maxBins``), and rows up to which cuts come from all values instead of quantiles.
BINS, EXACT_ROWS = 32, 10_000
#: Even ranks whose values stand for a feature with more rows.
RANKS, ACCURACY = 511, 5_000
#: Rows of a block, and rounds after which residuals are written anew.
BLOCK_ROWS, FOLDED = 16_384, 10
#: Histogram cells of a pass (nodes x features x bins); deeper trees and wider tables are left to MLlib.
CELLS = 1 << 16
#: Histograms that one task sums, when there are more.
FAN_IN = 128

_BLOCKS = "n int, bins binary, rest binary"
_SUMS = "part int, n binary, s binary"


@dataclass
class Node:
    """A node of a tree: a split (rows at ``place`` or below go left), or the mean of its rows."""

    count: float
    total: float
    feature: int = -1
    place: int = 0
    gain: float = 0.0
    children: list[Node] = field(default_factory=list)

    @property
    def mean(self) -> float:
        return self.total / self.count if self.count else 0.0


def fits(width: int, depth: int) -> bool:
    """Whether the histograms of the widest level stay small."""
    return depth <= 16 and (width * BINS << max(depth - 1, 0)) <= CELLS


def cuts_of(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Midpoints of neighbouring values: all when they are at most ``most``, else those nearest to even shares of the rows."""
    middle = values[:-1] / 2 + values[1:] / 2
    if len(middle) <= most:
        return middle
    stride, found = counts.sum() / (most + 1), []
    seen, target = counts[0], stride
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def find_cuts(data: DataFrame, rows: int, width: int) -> list[np.ndarray]:
    """Ascending cuts of each feature, of all its values in a small table, else of its values at even ranks, the least and the largest."""
    most = min(BINS, rows) - 1
    x = vector_to_array("features")
    if rows <= EXACT_ROWS:
        table = np.array([r["x"] for r in data.select(x.alias("x")).collect()], np.float64).reshape(-1, width)
        return [cuts_of(*np.unique(table[:, f], return_counts=True), most) for f in range(width)]
    values = data.select(x.alias("x"))
    ends = values.agg(*[g(F.col("x")[f]).alias(f"{n}{f}") for f in range(width) for n, g in (("l", F.min), ("m", F.max))]).first()
    between = [F.count_if((F.col("x")[f] > ends[f"l{f}"]) & (F.col("x")[f] < ends[f"m{f}"])).alias(f"b{f}") for f in range(width)]
    many = [f for f, n in enumerate(values.agg(*between).first()) if n]
    ranks = F.array(*[F.lit(i / (RANKS + 1)) for i in range(1, RANKS + 1)])
    row = values.agg(F.lit(0), *[F.percentile_approx(F.col("x")[f], ranks, ACCURACY).alias(f"q{f}") for f in many]).first().asDict()
    return [cuts_of(*np.unique([ends[f"l{f}"], *row.get(f"q{f}", []), ends[f"m{f}"]], return_counts=True), most) for f in range(width)]


def _blocks(data: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Rows as blocks: the place of each value among the cuts of its feature, feature by feature, those of two places eight to a byte; and the label."""
    width, sizes = len(cuts), [len(c) + 1 for c in cuts]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x, y = np.asarray(part.column("x").flatten(), np.float64).reshape(-1, width), np.asarray(part.column("label"), np.float64)
                if not (np.isfinite(x).all() and np.isfinite(y).all()):
                    raise ValueError("labels and features must be finite numbers")
                held = [np.searchsorted(c, x[:, f], "left").astype(np.uint8) for f, c in enumerate(cuts) if len(c) > 1]
                held += [np.packbits(np.stack([x[:, f] > cuts[f][0] for f in some], 1), axis=1) for some in _shared(sizes)]
                yield _block(b"".join(b.tobytes() for b in held), y)

    return data.select(vector_to_array("features").alias("x"), F.col("label").cast("double")).mapInArrow(pack, _BLOCKS)


def _block(bins: bytes, rest: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([len(rest)], pa.int32()), pa.array([bins], pa.binary()), pa.array([rest.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, ["n", "bins", "rest"])


def _shared(sizes: list[int]) -> list[list[int]]:
    """The features of two places, eight to a byte."""
    two = [f for f, size in enumerate(sizes) if size == 2]
    return [two[i : i + 8] for i in range(0, len(two), 8)]


class _Places:
    """The places of a block's rows: ``wide`` by feature, ``codes`` for eight features of two places each."""

    def __init__(self, packed: bytes, n: int, sizes: list[int]) -> None:
        held = np.frombuffer(packed, np.uint8).reshape(-1, n)
        self.rows, wide = n, [f for f, size in enumerate(sizes) if size > 2]
        self.wide, self.codes = dict(zip(wide, held)), held[len(wide) :]
        self.bits = {f: (g, 128 >> k) for g, some in enumerate(_shared(sizes)) for k, f in enumerate(some)}

    def above(self, f: int, place: int) -> np.ndarray:
        if f in self.wide:
            return self.wide[f] > place
        g, bit = self.bits[f]
        return (self.codes[g] & bit) > 0


def _unpacked(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[tuple[bytes, _Places, np.ndarray]]:
    """The packed places, the same by feature, and the residuals."""
    for batch in batches:
        for n, packed, rest in zip(*(batch.column(c) for c in ("n", "bins", "rest"))):
            packed = packed.as_py()
            yield packed, _Places(packed, n.as_py(), sizes), np.frombuffer(rest.as_buffer())


def _level_of(root: Node, bins: _Places, depth: int) -> tuple[np.ndarray, list[Node]]:
    """The number of the node that each row is in at ``depth``, or of the leaf before; and the nodes, from left to right."""
    nodes: list[Node] = []
    kind = np.uint8 if depth <= 8 else np.uint16

    def number(node: Node, left: int) -> np.ndarray | np.integer:
        if not left or not node.children:
            nodes.append(node)
            return kind(len(nodes) - 1)
        low, high = (number(c, left - 1) for c in node.children)
        return low ^ ((low ^ high) & np.negative(bins.above(node.feature, node.place).astype(kind)))  # high or low, without branches

    at = number(root, depth)
    return np.broadcast_to(at, bins.rows) if at.ndim == 0 else at, nodes


def _less(rest: np.ndarray, bins: _Places, trees: list[tuple[Node, float]], depth: int) -> np.ndarray:
    """``rest`` less the weighted predictions of the trees."""
    for root, weight in trees:
        at, nodes = _level_of(root, bins, depth)
        rest = rest - (weight * np.array([n.mean for n in nodes]))[at]
    return rest


def _histograms(blocks: DataFrame, sizes: list[int], trees: list[tuple[Node, float]], depth: int, scale: float, root: Node | None, level: int, many: bool):
    """Counts and sums of ``scale`` times the residuals by (node of ``level``, feature and place)."""
    starts = np.cumsum([0, *sizes])
    cells = int(starts[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = s = None
        shared = _shared(sizes)
        for _, bins, rest in _unpacked(batches, sizes):
            rest = scale * _less(rest, bins, trees, depth)
            at, nodes = (np.zeros(len(rest), np.uint8), [root]) if root is None else _level_of(root, bins, level)
            k = len(nodes)
            if n is None:
                n, s = np.zeros((k, cells)), np.zeros((k, cells))
                whole, codes = np.zeros((2, k)), np.zeros((2, len(shared), k, 256))
            node = at.astype(np.intp)
            whole += np.bincount(node, minlength=k), np.bincount(node, rest, k)
            place, wide = np.empty_like(node), node * BINS
            for f, held in bins.wide.items():
                cols = slice(starts[f], starts[f + 1])
                np.add(wide, held, out=place)
                n[:, cols] += np.bincount(place, minlength=k * BINS).reshape(k, BINS)[:, : sizes[f]]
                s[:, cols] += np.bincount(place, rest, k * BINS).reshape(k, BINS)[:, : sizes[f]]
            wide = node * 256
            for g, held in enumerate(bins.codes):
                np.add(wide, held, out=place)
                codes[0, g] += np.bincount(place, minlength=k * 256).reshape(k, 256)
                codes[1, g] += np.bincount(place, rest, k * 256).reshape(k, 256)
        if n is not None:
            for out, all_rows, by_code in zip((n, s), whole, codes):
                for f in np.flatnonzero(np.array(sizes) == 1).tolist():
                    out[:, starts[f]] = all_rows
                for some, held in zip(shared, by_code):
                    for j, f in enumerate(some):
                        high = held[:, (np.arange(256) & (128 >> j)) > 0].sum(axis=1)
                        out[:, starts[f]], out[:, starts[f] + 1] = all_rows - high, high
        if n is not None:
            part = TaskContext.get().partitionId() // FAN_IN
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (n, s))], ["part", "n", "s"])

    def added(table: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(v.as_buffer()) for v in table.column(c)) for c in ("n", "s")]
        return pa.table([table.column("part").slice(0, 1), *(pa.array([v.tobytes()], pa.binary()) for v in sums)], ["part", "n", "s"])

    found = blocks.mapInArrow(count, _SUMS)
    if many:
        found = found.groupBy("part").applyInArrow(added, _SUMS)
    rows = found.collect()  # FAN_IN short rows, or one for as many tasks
    return tuple(sum(np.frombuffer(r[c]) for r in rows).reshape(-1, cells) for c in ("n", "s"))


def _split(node: Node, n: np.ndarray, s: np.ndarray, sizes: list[int]) -> None:
    """The split of a node that lowers the variance most, the first of equal ones; none when no split does."""
    at, best = 0, (0.0,)
    for f, size in enumerate(sizes):
        left, sums = np.cumsum(n[at : at + size])[:-1], np.cumsum(s[at : at + size])[:-1]
        at += size
        inner = np.flatnonzero((left > 0) & (left < node.count))
        if len(inner):
            left, sums = left[inner], sums[inner]
            gain = np.square(sums - left * node.mean) / (left * (node.count - left))
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = float(gain[k]), f, int(inner[k]), float(left[k]), float(sums[k])
    if best[0] > 0:
        node.gain, node.feature, node.place, count, total = best  # the fall of the variance
        node.children = [Node(count, total), Node(node.count - count, node.total - total)]


def fit_boosted(data: DataFrame, *, rows: int, width: int, rounds: int, step: float, depth: int) -> tuple[list[Node], list[np.ndarray]]:
    """The trees of ``rounds`` rounds over ``(features, label)``, the first with weight 1, all others with ``step``; and the cuts of each feature."""
    cuts = find_cuts(data, rows, width)
    sizes = [len(c) + 1 for c in cuts]
    blocks = cut_lineage(_blocks(data, cuts), "boosting")
    files = blocks.inputFiles()
    blocks.persist()  # what is lost of it is read again
    many = blocks.rdd.getNumPartitions() > FAN_IN
    trees: list[Node] = []
    recent: list[tuple[Node, float]] = []
    for turn in range(rounds):
        root, scale = None, 2.0 if turn else 1.0
        for level in range(max(depth, 1)):
            n, s = _histograms(blocks, sizes, recent, depth, scale, root, level, many)
            if root is None:
                root = Node(n[0, : sizes[0]].sum(), s[0, : sizes[0]].sum())
            nodes = [root]
            for _ in range(level):
                nodes = [c for node in nodes for c in (node.children or [node])]
            if depth:
                for node, n_k, s_k in zip(nodes, n, s):
                    if not node.children:
                        _split(node, n_k, s_k, sizes)
            if not any(node.children for node in nodes):
                break
        trees.append(root)
        recent.append((root, step if turn else 1.0))
        if len(recent) == FOLDED and turn + 1 < rounds:
            after = _folded(blocks, recent, sizes, depth)
            blocks.unpersist()
            discard_files(data.sparkSession, files)
            blocks, recent, files = after, [], after.inputFiles()
            blocks.persist()
    blocks.unpersist()
    discard_files(data.sparkSession, files)
    return trees, cuts


def _folded(blocks: DataFrame, trees: list[tuple[Node, float]], sizes: list[int], depth: int) -> DataFrame:
    """The blocks with what the trees leave of the residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed, bins, rest in _unpacked(batches, sizes):
            yield _block(packed, _less(rest, bins, trees, depth))

    return cut_lineage(blocks.mapInArrow(run, _BLOCKS), "boosting")
