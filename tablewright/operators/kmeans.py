"""Lloyd iterations of many k-means starts in one scan a round."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from ..session import cut_lineage

#: Rows of a packed block.
BLOCK_ROWS = 8_192


def _packed(data: DataFrame, width: int) -> DataFrame:
    """The vectors as blocks of rows, written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = np.asarray(batch.slice(at, BLOCK_ROWS).column("x").flatten(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])

    return cut_lineage(data.select(vector_to_array("features").alias("x")).mapInArrow(pack, "x binary"), "kmeans")


def _round(blocks: DataFrame, starts: Sequence[np.ndarray], width: int) -> tuple[list[np.ndarray], list[float]]:
    """New centres of each start, and its cost under the old ones; a centre without points stays."""
    edges = np.cumsum([0, *(len(c) for c in starts)])
    centres = np.concatenate(starts)
    middle = centres.mean(axis=0)
    moved = centres - middle
    shared = blocks.sparkSession.sparkContext.broadcast((moved, np.einsum("ij,ij->i", moved, moved)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, squares = shared.value
        # For each centre the sums of its points, their number, and the cost.
        total = np.zeros((len(c), width + 2))
        for batch in batches:
            for block in batch.column("x"):
                x = np.frombuffer(block.as_buffer()).reshape(-1, width) - middle
                own = np.einsum("ij,ij->i", x, x)
                gaps = x @ c.T
                gaps *= -2.0
                gaps += squares[None, :]
                near = np.zeros((len(x), len(c)))
                for a, b in zip(edges[:-1], edges[1:]):
                    at = a + gaps[:, a:b].argmin(axis=1)
                    near[np.arange(len(x)), at] = 1.0
                    total[:, width + 1] += np.bincount(at, np.maximum(gaps[np.arange(len(x)), at] + own, 0.0), len(c))
                total[:, :width] += near.T @ x
                total[:, width] += near.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # One short line from each task, sized like the centres.
    total = np.zeros((len(centres), width + 2))
    for r in blocks.mapInArrow(add, "sums binary").collect():
        total += np.frombuffer(r["sums"]).reshape(total.shape)
    shared.unpersist()
    n = total[:, width : width + 1]
    found = np.where(n > 0, total[:, :width] / np.maximum(n, 1) + middle, centres)
    return [found[a:b] for a, b in zip(edges[:-1], edges[1:])], [float(total[a:b, width + 1].sum()) for a, b in zip(edges[:-1], edges[1:])]


def lloyd(data: DataFrame, starts: Sequence[np.ndarray], rounds: int, tol: float) -> tuple[np.ndarray, float]:
    """The centres of the start that ends with the lowest cost, and that cost.

    A start is done when no centre moves by more than ``tol``; its cost is that of its last round, as in MLlib. All starts that are not done
    go on together, so a round is one scan for all of them.
    """
    width = starts[0].shape[1]
    blocks = _packed(data, width)
    centres, cost = list(starts), [np.inf] * len(starts)
    live = list(range(len(starts)))
    for _ in range(rounds):
        found, costs = _round(blocks, [centres[i] for i in live], width)
        moving = []
        for i, new, c in zip(live, found, costs):
            if (np.square(new - centres[i]).sum(axis=1) > tol * tol).any():
                moving.append(i)
            centres[i], cost[i] = new, c
        live = moving
        if not live:
            break
    best = min(range(len(starts)), key=lambda i: cost[i])
    return centres[best], cost[best]
