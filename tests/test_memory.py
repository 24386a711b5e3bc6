"""What a task holds at once."""

import numpy as np

from tablewright.operators import value_counts
from tablewright.operators.forest import _unpack
from tablewright.operators.trees import Sorted


def test_blocks_are_used_up_and_orders_are_narrow():
    x = np.random.default_rng(2).normal(size=(6, 3))
    block = lambda at: {"ids": np.array(at, np.int64).tobytes(), "x": x[at].tobytes(), "y": x[at, 0].copy().tobytes()}
    rows = [block([4, 5]), block([0, 1, 2]), block([3])]
    ids, found, y = _unpack(rows, 3)
    assert not rows and ids.tolist() == list(range(6)) and (found == x).all() and (y == x[:, 0]).all()
    data = Sorted(found)
    assert data.x is found and all(o.dtype == np.int32 for o in data.order.values())


def test_a_task_counts_short_stretches():
    assert value_counts.STRETCH_BYTES <= 32 << 20 and value_counts.STRETCH_ROWS <= 1 << 18
