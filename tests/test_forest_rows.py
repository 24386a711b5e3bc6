"""How rows travel and stand while trees grow: narrow blocks, counted features, shared codes, rows numbered anew."""

import numpy as np
import pytest

from tablewright.operators import forest, trees


def table(n, seed):
    rng = np.random.default_rng(seed)
    hot = [np.eye(m)[rng.integers(0, m, n)] for m in (3, 5, 6)]
    return np.hstack([rng.integers(0, 7, (n, 1)) * 0.1, rng.normal(size=(n, 1)), *hot, np.full((n, 1), 2.5), rng.choice([-1.5, 4.0], (n, 4))])


def test_dealt_rows_are_narrow_and_come_back():
    x = table(4_001, 1)
    x[5, 0] = -0.0
    for at in (np.arange(4_001), np.array([7]), np.array([5, 6, 4_000])):
        held = forest.Narrow(x).rows(at)
        assert np.array_equal(forest._widened(held, len(at), x.shape[1]), x[at])
    # Two features of many values, bits for the others.
    assert len(forest.Narrow(x).rows(np.arange(4_001))) < 4_001 * 8 * 3
    assert np.array_equal(forest._widened(forest.Narrow(x[:, :2]).rows(at), 3, 2), x[at, :2])


@pytest.mark.parametrize("classes", [0, 3])
def test_ways_to_grow_agree(classes, monkeypatch):
    x = table(1_500, 2)
    rng = np.random.default_rng(3)
    y = rng.integers(0, classes, 1_500).astype(float) if classes else rng.integers(0, 10_000, 1_500) / 8
    outputs = forest.Plan(1, None, 3, classes, x.shape[1], 0).outputs(y)
    w = trees.bag_weights(np.arange(1_500), 1, 7)
    data = trees.Sorted(x)
    assert len(data.codes) < 8 and set(data.levels) == {0, 1} and not data.order.keys() & data.member.keys()
    want = trees.grow(data, y, outputs, w)
    assert (want.value[want.leaves(x)][w > 0] == outputs.T[w > 0]).all()
    for name, value in (("FEW", 0), ("PATTERNS", 2), ("COMPACTED", frozenset()), ("COMPACTED", frozenset(range(1, 99)))):
        with monkeypatch.context() as m:
            m.setattr(trees, name, value)
            got = trees.grow(trees.Sorted(x), y, outputs, w)
        assert np.array_equal(got.feature, want.feature) and np.array_equal(got.cut, want.cut) and np.allclose(got.value, want.value)


def test_codes_of_shared_features():
    x = table(800, 4)
    data = trees.Sorted(x)
    for f, (g, inner) in data.member.items():
        assert np.array_equal(inner[data.codes[g]], x[:, f] == x[:, f].max())
        assert len(inner) <= trees.PATTERNS


def test_labels_that_are_no_numbers_fail():
    x = table(300, 5)
    y = np.where(np.arange(300) == 7, np.nan, np.arange(300.0))
    with pytest.raises(ValueError, match="finite"):
        trees.grow(trees.Sorted(x), y, y[None], np.ones(300, int))
