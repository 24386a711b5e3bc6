"""What tiles look at and what they are sent."""

import numpy as np

from tablewright.operators import cells


def test_cells_share_shards():
    pivots = np.random.default_rng(3).normal(size=(500, 3))
    held = cells.Cells(pivots, dict.fromkeys(range(500), 1.0), {**dict.fromkeys(range(500), 2_000), 7: 200_000})
    plan = held.shards()
    assert len(plan) == 500 and plan[7][1] == 4  # a large cell is cut
    load = np.zeros(max(a + n for a, n in plan.values()))
    for cell, (first, parts) in plan.items():
        load[first : first + parts] += held.rows[cell] / parts
    # A query goes to each shard once, not to each cell.
    assert load.max() <= held.side_rows and len(load) < 30


def test_near_pairs_at_the_very_radius():
    grid = np.stack(np.meshgrid(*[np.arange(12.0)] * 2), axis=-1).reshape(-1, 2) + 1e4
    want = ((grid[:, None] - grid[None]) ** 2).sum(-1) <= 25
    assert (cells.within_radius(grid, grid, 5.0) == want).all()
    assert not (cells.within_radius(grid, grid, 5.0 - 1e-9) == want).all()
