"""The neighbour search by boxes: exact, with ties, and with few pairs compared."""

import numpy as np
import pytest

from tablewright.operators import boxes


def mixed(n, seed):
    """Numbers beside one-hot categories, as feature tables have them."""
    rng = np.random.default_rng(seed)
    parts = [rng.uniform(-1.7, 1.7, (n, 3)), rng.integers(0, 7, (n, 1)) * 0.5]
    return np.hstack([*parts, *(np.eye(m)[rng.integers(0, m, n)] for m in (3, 5, 6))])


def brute(a, b, k):
    far = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    line = np.sort(far, axis=1)[:, min(k, len(b)) - 1]
    return {(i, j): far[i, j] for i in range(len(a)) for j in np.flatnonzero(far[i] <= line[i])}


@pytest.mark.parametrize("k,rows", [(1, 900), (11, 900), (11, 7)])
def test_nearest_is_exact(k, rows, monkeypatch):
    monkeypatch.setattr(boxes, "HELD", 50)
    for a, b in (
        (mixed(150, 1), mixed(rows, 2)),
        (mixed(150, 1).round(), np.unique(mixed(rows, 2).round(), axis=0)),  # equal distances
        (np.full((3, 2), 5.0), np.full((rows, 2), 4.0)),  # all points alike
    ):
        want = brute(a, b, k)
        for limit in (np.full(len(a), np.inf), brute_limits(want, len(a))):
            i, j, distance = boxes.nearest(a, limit, b, k)
            got = dict(zip(zip(i.tolist(), j.tolist()), distance.tolist()))
            assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def brute_limits(want, n):
    out = np.zeros(n)
    for (i, _), far in want.items():
        out[i] = max(out[i], far)
    return out


def test_parts_and_leaves_out_of_reach_are_passed_by(monkeypatch):
    a, b = mixed(2_000, 3), mixed(30_000, 4)
    want = boxes.nearest(a, np.full(len(a), np.inf), b, 5)
    seen = []
    plain = boxes.rough_squares
    monkeypatch.setattr(boxes, "rough_squares", lambda x, y: seen.append(len(x) * len(y)) or plain(x, y))
    limit = np.zeros(len(a))
    np.maximum.at(limit, want[0], want[2])
    got = boxes.nearest(a, limit, b, 5)
    assert np.array_equal(got[1], want[1]) and sum(seen) < 0.1 * len(a) * len(b)
    tree = boxes.halves(b[:2_000], 40)
    at = tree.parts(b)
    lists = [np.flatnonzero(at == p) for p in range(len(tree.centres))]
    low, high = boxes.around(b, lists)
    radius = np.array([np.sqrt(((b[r] - c) ** 2).sum(1)).max() for r, c in zip(lists, tree.centres)])
    parts = boxes.Parts(tree, low, high, radius, np.bincount(at), 1_000)
    meets = parts.meets(a, limit)
    assert meets[want[0], at[want[1]]].all() and meets.mean() < 0.5
    assert (parts.bound(a, 5) >= limit).all()
