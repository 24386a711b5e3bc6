"""Blocks of boosting: features of two places share bytes, and rows are told apart as by a plain walk."""

import numpy as np
import pyarrow as pa

from tablewright.operators import boosting
from tablewright.operators.boosting import Node

SIZES = [5, 2, 1, *[2] * 9, 32]


def block(n=500):
    rng = np.random.default_rng(2)
    places = np.stack([rng.integers(0, size, n) for size in SIZES], 1).astype(np.uint8)
    held = [places[:, f] for f, size in enumerate(SIZES) if size > 2]
    held += [np.packbits(places[:, some].astype(bool), axis=1) for some in boosting._shared(SIZES)]
    return places, boosting._block(b"".join(h.tobytes() for h in held), rng.normal(size=n))


def walk(node, row, left):
    while left and node.children:
        node, left = node.children[int(row[node.feature] > node.place)], left - 1
    return node


def test_places_share_bytes_and_rows_find_their_nodes():
    places, batch = block()
    ((packed, bins, rest),) = boosting._unpacked(iter([batch]), SIZES)
    assert len(packed) == 500 * 4  # two wide features, ten of two places in two bytes
    for f, size in enumerate(SIZES):
        for place in range(size - 1):
            assert np.array_equal(bins.above(f, place), places[:, f] > place)
    inner = Node(3, 1, 4, 0, 1.0, [Node(1, 1), Node(2, 2, 12, 20, 1.0, [Node(1, 5), Node(1, 7)])])
    root = Node(9, 1, 0, 2, 1.0, [inner, Node(6, 3)])
    for depth in (0, 1, 2, 3, 9):
        at, nodes = boosting._level_of(root, bins, depth)
        assert [nodes[k] for k in at] == [walk(root, row, depth) for row in places]
    assert np.allclose(boosting._less(rest, bins, [(root, 0.5)], 3), rest - 0.5 * np.array([walk(root, row, 3).mean for row in places]))


def test_histograms_of_shared_places(monkeypatch):
    places, batch = block()
    rest = np.frombuffer(batch.column("rest")[0].as_buffer())

    class Once:
        def mapInArrow(self, run, _):
            self.rows = pa.Table.from_batches(run(iter([batch, batch]))).to_pylist()
            return self

        def collect(self):
            return self.rows

    monkeypatch.setattr(boosting, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))}))
    root = Node(9, 1, 0, 2, 1.0, [Node(3, 1), Node(6, 3)])
    n, s = boosting._histograms(Once(), SIZES, [], 3, 2.0, root, 1, False)
    starts = np.cumsum([0, *SIZES])
    for k, inside in enumerate((places[:, 0] <= 2, places[:, 0] > 2)):
        for f, size in enumerate(SIZES):
            here = places[inside, f]
            assert np.array_equal(n[k, starts[f] : starts[f + 1]], 2 * np.bincount(here, minlength=size))
            assert np.allclose(s[k, starts[f] : starts[f + 1]], 4 * np.bincount(here, rest[inside], size))
