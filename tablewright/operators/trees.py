"""One decision tree over rows in memory, grown to any depth, all nodes of a level at once (NumPy).

A tree is kept in level order: the children of its k-th inner node are its nodes ``2k + 1`` and ``2k + 2``, so only
the feature of each node (-1 for a leaf), the cuts of the inner nodes and the values of the leaves are stored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = -1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of splitmix64)."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# P(Poisson(1) <= k) for k = 0, 1, ... up to rounding.
_POISSON = np.exp(-1.0) * np.cumsum(1 / np.cumprod(np.r_[1.0, np.arange(1.0, 18.0)]))


def bag_weights(row_ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap sample holds each row: Poisson(1), from row id, tree and seed alone."""
    with np.errstate(over="ignore"):
        key = mix(row_ids) ^ mix(np.uint64(tree) + (np.uint64(seed) << np.uint64(32)))
    return np.searchsorted(_POISSON, (mix(key) >> np.uint64(11)) * 2.0**-53, "right").astype(np.int64)


@dataclass
class Tree:
    feature: np.ndarray  # int32, one for each node
    cut: np.ndarray  # one for each inner node; rows above it go to the right child
    value: np.ndarray  # leaves x outputs

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf of each row of ``x``."""
        inner = np.cumsum(self.feature != LEAF) - 1
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            rows = rows[self.feature[node[rows]] != LEAF]
            if not len(rows):
                return node - inner[node] - 1
            here = node[rows]
            k = inner[here]
            node[rows] = 2 * k + 1 + (x[rows, self.feature[here]] > self.cut[k])

    def size(self) -> int:
        return self.feature.nbytes + self.cut.nbytes + self.value.nbytes


def midpoint(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A value from ``low`` on and below ``high``."""
    middle = low / 2 + high / 2
    return np.where((middle >= high) | (middle < low), low, middle)


#: Values of a feature up to which they are counted while there are more rows than counts, and patterns of features of two values.
FEW, PATTERNS = 4_096, 8


class Sorted:
    """Rows prepared for many trees: an order by value for each feature; features of two values share codes of the patterns that they make."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = np.asfortranarray(x, np.float64)
        self.order: dict[int, np.ndarray] = {}
        self.rank: dict[int, np.ndarray] = {}
        self.codes: list[np.ndarray] = []
        self.member: dict[int, tuple[int, np.ndarray]] = {}  # which codes, and which of them are upper rows of the feature
        self.two: dict[int, tuple[float, float]] = {}
        self.levels: dict[int, np.ndarray] = {}  # the values of a feature with few
        for f in range(x.shape[1]):
            column = self.x[:, f]
            order = np.argsort(column, kind="stable").astype(np.int32)  # held for all trees, so narrow
            steps = np.r_[0, np.cumsum(np.diff(column[order]) != 0)].astype(np.int32)
            if len(steps) and steps[-1] == 1:
                high = column[order[-1]]
                self.two[f] = column[order[0]], high
                self._share(f, column == high)
            elif len(steps) and steps[-1] > 1:
                self.order[f], self.rank[f] = order, np.empty(len(order), np.int32)
                self.rank[f][order] = steps
                if steps[-1] < FEW:
                    self.levels[f] = column[order[np.searchsorted(steps, np.arange(steps[-1] + 1))]]


    def _share(self, f: int, upper: np.ndarray) -> None:
        """Adds a feature of two values to the last codes, if they stay few, else to new ones."""
        g = len(self.codes) - 1
        both = 2 * self.codes[g] + upper if self.codes else None
        kept = np.flatnonzero(np.bincount(both, minlength=2 * PATTERNS)) if self.codes else np.zeros(0, np.int64)
        if self.codes and len(kept) <= PATTERNS:
            number = np.zeros(2 * PATTERNS, np.uint8)
            number[kept] = np.arange(len(kept))
            self.codes[g] = number[both]
            self.member = {e: (h, u[kept // 2] if h == g else u) for e, (h, u) in self.member.items()}
            self.member[f] = g, kept % 2 == 1
        else:
            self.codes.append(upper.astype(np.uint8))
            self.member[f] = g + 1, np.array([False, True])


def sampled(valid: np.ndarray, keys: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Of the valid features of each node (nodes x features) ``most`` at random, by node key and seed alone."""
    if most >= valid.shape[1]:
        return valid
    features = mix(np.arange(valid.shape[1]) + (np.int64(seed) << 20))
    draw = np.where(valid, mix(keys[:, None] ^ features[None, :]) >> np.uint64(1), np.uint64(2**64 - 1))
    line = np.partition(draw, most - 1, axis=1)[:, most - 1]
    return valid & (draw <= line[:, None])


#: Gains that differ by less, relatively, are equal.
TIE = 1e-9


class _Level:
    """Running best splits of a level's nodes."""

    def __init__(self, nodes: int, features: int, sample: bool) -> None:
        self.gain, self.feature, self.cut = np.full(nodes, -1.0), np.full(nodes, LEAF, np.int32), np.zeros(nodes)
        # All gains are needed only when features are drawn afterwards.
        self.all = np.full((nodes, features), -1.0) if sample else None
        self.cuts = np.zeros((nodes, features)) if sample else None

    def offer(self, f: int, nodes: np.ndarray, gain: np.ndarray, cut: np.ndarray) -> None:
        if self.all is not None:
            self.all[nodes, f], self.cuts[nodes, f] = gain, cut
            return
        held = self.gain[nodes]
        better = (gain > held * (1 + TIE)) | (held < 0)
        nodes = nodes[better]
        self.gain[nodes], self.feature[nodes], self.cut[nodes] = gain[better], f, cut[better]

    def choose(self, keys: np.ndarray, most: int, seed: int) -> None:
        if self.all is None:
            return
        gains = np.where(sampled(self.all >= 0, keys, most, seed), self.all, -1.0)
        best = first_best(gains)
        at = np.arange(len(best))
        self.gain, self.cut = gains[at, best], self.cuts[at, best]
        self.feature = np.where(self.gain >= 0, best, LEAF).astype(np.int32)


def first_best(gains: np.ndarray) -> np.ndarray:
    """The first place in each row whose gain equals the largest one."""
    most = gains.max(axis=1, keepdims=True)
    return (gains >= np.where(most > 0, most * (1 - TIE), most)).argmax(axis=1)


def _centre(y: np.ndarray, weight: np.ndarray) -> float:
    """About the mean, a multiple of a power of two about the deviation: whole numbers stay exact when it is taken off."""
    mean = np.average(y, weights=weight)
    step = 2.0 ** np.floor(np.log2(max(np.std(y), 1e-300)))
    return float(np.round(mean / step) * step) if np.isfinite(mean / step) else float(mean)


def _first_of_runs(gain: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of equal ``node`` the place of its largest gain, the first of equal ones; and the nodes."""
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    most = np.maximum.reduceat(gain, start) * (1 - TIE)
    best = np.flatnonzero(gain >= np.repeat(most, np.diff(np.r_[start, len(node)])))
    first = np.r_[True, node[best[1:]] != node[best[:-1]]]
    return best[first], node[start]


def _counted(place: np.ndarray, weight: np.ndarray, centred: list[np.ndarray], w: np.ndarray, values: int) -> tuple[np.ndarray, ...]:
    """The nodes that a feature of few values splits, with gain, value below and value above the cut; ``place``: node and value of each row."""
    cells = len(w) * values
    here = np.bincount(place, weight, cells).reshape(-1, values)
    left = np.cumsum(here, axis=1)
    inner = (here > 0) & (left < w[:, None])
    nodes = np.flatnonzero(inner.any(axis=1))
    gain = sum(np.square(np.cumsum(np.bincount(place, c, cells).reshape(-1, values), axis=1)) for c in centred)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(inner, gain / (left * (w[:, None] - left)), -1.0)[nodes]
    low, at = first_best(gain), np.arange(len(nodes))
    high = ((here[nodes] > 0) & (np.arange(values) > low[:, None])).argmax(axis=1)
    return nodes, gain[at, low], low, high


#: Levels before which rows are numbered anew.
COMPACTED = frozenset((2, 4, 6, 9, 13, 18, 24, 32, 48, 64, 96, 128))


def grow(
    data: Sorted, label: np.ndarray, outputs: np.ndarray, weights: np.ndarray, *, depth: int | None = None, most: int | None = None,
    seed: int = 0, key: int = 1,
) -> Tree:
    """A tree over the rows with a weight, split until labels or all features are equal, or ``depth`` is reached.

    ``outputs`` (outputs x rows) are what leaves average and what splits make less varied: the label itself, or an
    indicator for each class, for which the variance is half the Gini impurity. The split with the largest gain is taken, of equal ones
    that of the first feature and the lowest cut. ``most``: how many features are drawn for each node.

    Rows stand sorted by each feature within their node. With outputs centred in every node, a split gains
    L² / (l · (w - l)) times the node's weight w, where l and L are weight and sum on one side; both are running sums.
    """
    x, width = data.x, data.x.shape[1]
    most = width if most is None else most
    inside = weights > 0
    base = np.flatnonzero(inside)  # the row that each number stands for
    weight = weights[base].astype(np.float64)
    shift = [_centre(y[base], weight) for y in outputs]
    parts = [weight * (y[base] - s) for y, s in zip(outputs, shift)]  # weighted outputs, centred against cancellation
    label = label[base]
    if data.order and not np.isfinite(label).all():
        raise ValueError("labels must be finite numbers")
    rows = np.arange(len(base))  # indices are as wide as NumPy wants them, or each use would widen them
    number = np.cumsum(inside) - 1
    counted = set(data.levels)  # these features are put in order only when their nodes are small
    order = {f: number[o[inside[o]]] for f, o in data.order.items() if f not in counted}
    codes = [c[base] for c in data.codes]
    rank = {f: r[base] for f, r in data.rank.items()}
    del number, inside
    node_of = np.zeros(len(base), np.int64)
    # Nodes of a level are numbered as their rows stand; ``spot`` is a node's place in level order.
    spot = np.zeros(1, np.int64)
    counts = np.array([len(rows)])
    keys = mix(np.array([key]))
    features, cuts, values = [], [], []
    total_w, totals = np.array([weight.sum()]), [np.array([p.sum()]) for p in parts]
    pure = np.array([label.min() == label.max()])
    level, left_nodes = 0, 1
    while True:
        if depth is not None and level >= depth:
            pure = np.ones(len(pure), bool)
        live = np.flatnonzero(~pure)
        n = len(live)
        best = _Level(n, width, most < width)
        if n:
            if pure.any():
                # Leaves leave the arrangements; the other nodes are numbered anew.
                node_of[rows] = np.where(pure, -1, np.cumsum(~pure) - 1)[node_of[rows]]
                rows = rows[node_of[rows] >= 0]
            if level:
                left_live = int(np.count_nonzero(~pure[:left_nodes]))
                order = {f: _dealt(o, node_of, left_live) for f, o in order.items()}
            if level in COMPACTED and len(rows):
                # Rows are numbered as they stand: what a node reads lies together.
                number = np.empty(len(base), np.int64)
                number[rows] = np.arange(len(rows))
                order, codes = {f: number[o] for f, o in order.items()}, [c[rows] for c in codes]
                base, weight, label, node_of = base[rows], weight[rows], label[rows], node_of[rows]
                parts, rank = [p[rows] for p in parts], {f: r[rows] for f, r in rank.items()}
                rows = np.arange(len(rows))
            w = total_w[live]
            node = np.repeat(np.arange(n), counts[live])
            together = node[1:] == node[:-1]
            ends = np.cumsum(counts[live])[:-1] - 1
            before = np.cumsum(w) - w
            centred, standing, held, sums = [], [], weight[rows], {}
            for p, total in zip(parts, totals):
                c = np.zeros(len(p))
                standing.append(p[rows] - held * (total[live] / w)[node])
                c[rows] = standing[-1]
                centred.append(c)
            for f in range(width):
                if f in counted:
                    most_values = len(data.levels[f])
                    place = node * most_values + rank[f][rows]
                    if n * most_values <= len(rows):
                        found = _counted(place, held, standing, w, most_values)
                        best.offer(f, found[0], found[1], midpoint(*(data.levels[f][v] for v in found[2:])))
                        continue
                    counted.remove(f)
                    order[f] = rows[np.argsort(place, kind="stable")]
                if f in order:
                    o = order[f]
                    r = rank[f][o]
                    place = np.flatnonzero((r[1:] != r[:-1]) & together)
                    if not len(place):
                        continue
                    at = node[place]
                    left = np.cumsum(weight[o])[place] - before[at]
                    # Less what rounding left over from the nodes before, or equal gains would differ.
                    run = [np.cumsum(c[o]) for c in centred]
                    gain = sum(np.square(r[place] - np.r_[0.0, r[ends]][at]) for r in run) / (left * (w[at] - left))
                    found, nodes = _first_of_runs(gain, at)
                    low, high = x[base[o[place[found]]], f], x[base[o[place[found] + 1]], f]
                    best.offer(f, nodes, gain[found], midpoint(low, high))
                elif f in data.member:
                    g, inner = data.member[f]
                    if g not in sums:
                        place, size = node * len(inner) + codes[g][rows], n * len(inner)
                        sums[g] = [np.bincount(place, v, size).reshape(n, -1) for v in (held, *standing)]
                    right, *gain = (v[:, inner].sum(axis=1) for v in sums[g])
                    nodes = np.flatnonzero((right > 0) & (right < w))
                    if len(nodes):
                        right = right[nodes]
                        gain = sum(np.square(v[nodes]) for v in gain) / (right * (w[nodes] - right))
                        best.offer(f, nodes, gain, np.broadcast_to(midpoint(*map(np.asarray, data.two[f])), len(nodes)))
            best.choose(keys[live], most, seed)
        feature = np.full(len(pure), LEAF, np.int32)
        feature[live] = best.feature
        at = np.argsort(spot)  # from here to the cuts in level order
        features.append(feature[at])
        ends = at[feature[at] == LEAF]
        values.append(np.stack([t[ends] / total_w[ends] + s for t, s in zip(totals, shift)], axis=1))
        inner = np.flatnonzero(best.feature != LEAF)
        if not len(inner):
            return Tree(np.concatenate(features), np.concatenate([*cuts, np.zeros(0)]), np.concatenate(values))
        by_spot = np.argsort(spot[live][inner])
        cuts.append(best.cut[inner][by_spot])
        # The left children are numbered first, then the right ones, each in the order of their parents: so rows are dealt to
        # children by taking the left ones and then the right ones, however many nodes there are.
        m = left_nodes = len(inner)
        place = np.empty(m, np.int64)
        place[by_spot] = np.arange(m)
        spot = np.r_[2 * place, 2 * place + 1]
        child = np.full(n, -1)
        child[inner] = np.arange(m)
        at = node_of[rows]
        now = child[at]
        right = x[base[rows], np.maximum(best.feature, 0)[at]] > best.cut[at]
        node_of[rows] = np.where(now < 0, -1, now + m * right)
        keys = keys[live][inner]
        keys = mix(np.r_[keys * np.uint64(2), keys * np.uint64(2) + np.uint64(1)])
        rows = _dealt(rows, node_of, m)
        at = node_of[rows]
        counts = np.bincount(at, minlength=2 * m)
        total_w = np.bincount(at, weight[rows], 2 * m)
        totals = [np.bincount(at, p[rows], 2 * m) for p in parts]
        start = np.cumsum(counts) - counts
        shown = label[rows]
        pure = np.minimum.reduceat(shown, start) == np.maximum.reduceat(shown, start)
        level += 1


def _dealt(rows: np.ndarray, node_of: np.ndarray, left: int) -> np.ndarray:
    """Rows, grouped by parent, grouped by child instead (numbers below ``left`` are left children); rows of leaves go."""
    now = node_of[rows]
    return np.concatenate([rows[(now >= 0) & (now < left)], rows[now >= left]])
