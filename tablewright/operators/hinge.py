"""Linear classifiers with squared hinge loss, by Newton steps over sums of products.

Minimised is w·w / 2 + C Σ max(0, 1 - y w·z)² with y = ±1 and z the features and a constant 1, one problem for each class against the
rest. The loss is a quadratic of the rows that are inside the margin; one scan sums their products for all classes, the step solves
the quadratic, and when no row changes sides any more the minimum is met exactly. Of wide tables the matrix is never
summed up: conjugate gradients ask for its products with vectors, one scan each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features up to which products of all pairs are summed.
MATRIX_FEATURES = 1024
#: The gradient at the end is at most this share of that at the start.
TOLERANCE = 1e-9
SHORTEST_STEP = 2.0**-20


@dataclass
class HingeFit:
    """Weights (classes x features), intercepts, and the largest gradient left, as a share of that at zero."""

    weights: np.ndarray
    intercepts: np.ndarray
    residual: float
    rounds: int


def _sums(data: DataFrame, size: tuple[int, ...], work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``work`` (z, label) gives for a block of them: an array of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            label = np.asarray(batch.column("label"), np.float64)
            x = np.asarray(batch.column("x").flatten(), np.float64).reshape(len(label), -1)
            total += work(np.c_[x, np.ones(len(label))], label)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "s"])

    rows = data.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    found = rows.mapInArrow(run, "place bigint, s double").groupBy("place").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(int(np.prod(size)))
    out[found["place"]] = found["s"]
    return out.reshape(size)


def _inside(z: np.ndarray, label: np.ndarray, cls: float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows inside the margin, and y times their distance from it."""
    y = np.where(label == cls, 1.0, -1.0)
    room = 1 - y * (z @ w)
    at = room > 0
    return z[at], (y * room)[at]


def _state(data: DataFrame, classes: Sequence[float], w: np.ndarray, c: float, matrix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Objective, gradient and (if asked for) second derivatives at ``w`` for every class, from one scan."""
    d = w.shape[1]

    def work(z: np.ndarray, label: np.ndarray) -> np.ndarray:
        out = np.zeros((len(classes), d + 1, d + 1 if matrix else 1))
        for k, cls in enumerate(classes):
            inside, room = _inside(z, label, cls, w[k])
            both = np.c_[inside, room]
            out[k] = both.T @ (both if matrix else room[:, None])
        return out

    total = _sums(data, (len(classes), d + 1, d + 1 if matrix else 1), work)
    value = (w * w).sum(axis=1) / 2 + c * total[:, d, -1]
    gradient = w - 2 * c * total[:, :d, -1]
    second = np.eye(d)[None] + 2 * c * total[:, :d, :d] if matrix else None
    return value, gradient, second


def _conjugate_step(data: DataFrame, classes: Sequence[float], w: np.ndarray, c: float, gradient: np.ndarray) -> np.ndarray:
    """The Newton step of all classes without their matrices: each round of conjugate gradients is one scan."""
    step, rest = np.zeros_like(w), -gradient
    way, size = rest.copy(), (rest * rest).sum(axis=1)
    goal = 1e-4 * size
    for _ in range(w.shape[1]):
        going = size > goal
        if not going.any():
            break

        def work(z: np.ndarray, label: np.ndarray) -> np.ndarray:
            out = np.zeros_like(w)
            for k in np.flatnonzero(going):
                inside, _ = _inside(z, label, classes[k], w[k])
                out[k] = inside.T @ (inside @ way[k])
            return out

        image = way + 2 * c * _sums(data, w.shape, work)
        length = np.where(going, size / np.maximum((way * image).sum(axis=1), 1e-300), 0.0)[:, None]
        step, rest = step + length * way, rest - length * image
        left = (rest * rest).sum(axis=1)
        way, size = np.where(going[:, None], rest + (left / np.maximum(size, 1e-300))[:, None] * way, way), np.where(going, left, size)
    return step


def fit_squared_hinge(data: DataFrame, width: int, classes: Sequence[float], c: float, max_rounds: int = 1000) -> HingeFit:
    """One linear classifier for each of ``classes`` against all other labels, over ``(features, label)``."""
    w = np.zeros((len(classes), width + 1))
    matrix = width <= MATRIX_FEATURES
    value, gradient, second = _state(data, classes, w, c, matrix)
    start = np.maximum(np.abs(gradient).max(axis=1), 1e-300)
    rounds = 0
    while rounds < max_rounds and (np.abs(gradient).max(axis=1) > TOLERANCE * start).any():
        rounds += 1
        if matrix:
            step = np.stack([np.linalg.solve(h, -g) for h, g in zip(second, gradient)])
        else:
            step = _conjugate_step(data, classes, w, c, gradient)
        length = np.ones(len(classes))
        while True:
            next_w = w + length[:, None] * step
            found = _state(data, classes, next_w, c, matrix)
            worse = found[0] > value + 1e-12 * np.abs(value)
            if not worse.any() or length[worse].max() < SHORTEST_STEP:
                break
            length = np.where(worse, length / 2, length)
        still = np.abs(next_w - w).max() <= 1e-15 * max(np.abs(w).max(), 1e-300)
        w, (value, gradient, second) = next_w, found
        if still:
            break
    residual = float((np.abs(gradient).max(axis=1) / start).max())
    return HingeFit(w[:, :-1], w[:, -1], residual, rounds)
