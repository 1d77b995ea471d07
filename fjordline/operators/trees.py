"""Many small tree ensembles grown together.

A task gets the rows of many fits (one a run, batch or step) and grows all their trees at once: features are cut into bins once for each fit; at every level one pass over the rows
sums gradients by (fit, tree, node, feature, bin) and one pass over the sums finds the best split of every node. Boosting adds one tree a fit (and class) a round; bagging grows all trees
of all fits side by side. The work of a level is proportional to rows times features, whatever the number of nodes.

Growth is by ``level``, by ``leaf`` (best first, with a budget of leaves) or ``symmetric`` (one split for all nodes of a level). Rows and columns are sampled by a hash of the fit's
seed, so that a fit doesn't depend on which others share its task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Gains are compared to this many digits; the first feature, then the lowest bin, wins among equals.
DIGITS = 10


@dataclass(frozen=True)
class Boosting:
    rounds: int
    rate: float
    depth: int
    growth: str = "level"
    leaves: int = 31
    least_rows: int = 20
    least_hess: float = 1e-3
    ridge: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    balanced: bool = True
    bins: int = 255


@dataclass(frozen=True)
class Bagging:
    trees: int
    depth: int
    bins: int = 255
    least_rows: int = 1
    least_hess: float = 1e-12
    ridge: float = 0.0
    growth: str = "level"
    leaves: int = 1 << 30


@dataclass
class Fit:
    """Training columns and classes (0 .. k - 1), the rows to predict, and a seed."""

    x: np.ndarray
    y: np.ndarray
    rest: np.ndarray
    seed: int


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of integers (SplitMix64 steps), elementwise."""
    x = np.zeros(np.broadcast_shapes(*(np.shape(p) for p in parts)), np.uint64)
    for p in parts:
        x = x + np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x


def cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of the bins of one column: halfway between neighbouring values where these are few enough, else between quantiles."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="midpoint"))


class _Block:
    """The rows of several fits below each other, training rows first in each fit."""

    def __init__(self, fits: list[Fit], bins: int, balanced: bool):
        sizes = [len(f.y) + len(f.rest) for f in fits]
        self.fits, self.k = len(fits), max(2, *(int(f.y.max()) + 1 for f in fits))
        self.fit = np.repeat(np.arange(len(fits)), sizes)
        self.at = np.concatenate([np.arange(n) for n in sizes])
        self.train = self.at < np.repeat([len(f.y) for f in fits], sizes)
        self.seed = np.array([f.seed for f in fits], np.uint64)
        self.n = np.array([len(f.y) for f in fits])
        self.y = np.full(len(self.fit), -1)
        self.y[self.train] = np.concatenate([f.y for f in fits])
        self.bins = np.zeros((len(self.fit), fits[0].x.shape[1]), np.int32)
        start = 0
        for f, n in zip(fits, sizes, strict=True):
            both = np.vstack([f.x, f.rest])
            for j in range(both.shape[1]):
                self.bins[start : start + n, j] = np.searchsorted(cuts(f.x[:, j], bins), both[:, j], "left")
            start += n
        self.weight = np.where(self.train, 1.0, 0.0)
        if balanced:
            of = np.zeros((self.fits, self.k))
            np.add.at(of, (self.fit[self.train], self.y[self.train]), 1)
            self.weight[self.train] = (self.n[self.fit] / (np.maximum((of > 0).sum(1), 1)[self.fit] * np.maximum(of[self.fit, self.y], 1)))[self.train]


class _Growth:
    """The trees of many units (a unit is one tree) over unit-rows; sums are taken over the live rows alone, all rows are led to a leaf."""

    def __init__(self, unit: np.ndarray, bins: np.ndarray, units: int, options, order: list[np.ndarray] | None = None):
        self.unit, self.bins, self.units, self.o = unit, bins, units, options
        self.order = order or [np.lexsort((bins[:, j], unit)) for j in range(bins.shape[1])]

    def grow(self, g: np.ndarray, h: np.ndarray, live: np.ndarray, allowed=None) -> np.ndarray:
        """(rows, outputs): the leaf value of each row, the sum of ``g`` over the sum of ``h`` and the ridge of its leaf. ``allowed`` gives for (units, paths) of nodes
        the mask of features they may use."""
        self.g, self.h, self.live, self.allowed = g, h, live, allowed
        node = self.unit.copy()
        value = np.zeros(g.shape)
        return {"level": self._by_level, "leaf": self._by_leaf, "symmetric": self._symmetric}[self.o.growth](node, value)

    def _sums(self, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(self.live & (node >= 0))
        at = node[rows]
        g = np.stack([np.bincount(at, self.g[rows, k], nodes) for k in range(self.g.shape[1])], 1)
        return g, np.bincount(at, self.h[rows], nodes), np.bincount(at, minlength=nodes)

    def _worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (g * g).sum(-1) / np.maximum(h + self.o.ridge, 1e-300)

    def _edges(self, node: np.ndarray, j: int, total) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, bin, gain) of every place between two neighbouring bins of feature ``j`` within a node, in the order of nodes and bins."""
        o = self.order[j]
        o = o[(node[o] >= 0) & self.live[o]]
        o = o[np.argsort(node[o], kind="stable")]
        at, b = node[o], self.bins[o, j]
        last = np.flatnonzero((at[1:] == at[:-1]) & (b[1:] != b[:-1]))
        if not len(last):
            return at[:0], b[:0], np.zeros(0)
        tg, th, tn = total
        first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(tn)))])[:-1][at[last]]
        cg, ch = np.vstack([np.zeros((1, self.g.shape[1])), np.cumsum(self.g[o], 0)]), np.concatenate([[0], np.cumsum(self.h[o])])
        g, h, n = cg[last + 1] - cg[first], ch[last + 1] - ch[first], last + 1 - first
        at, b = at[last], b[last]
        gain = self._worth(g, h) + self._worth(tg[at] - g, th[at] - h) - self._worth(tg[at], th[at])
        ok = (n >= self.o.least_rows) & (tn[at] - n >= self.o.least_rows) & (h >= self.o.least_hess) & (th[at] - h >= self.o.least_hess)
        return at, b, np.where(ok, gain, -np.inf).round(DIGITS)

    def _splits(self, node: np.ndarray, total, units: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gain, feature, bin) of the best split of each node."""
        best, feature, cut = np.full(len(units), 0.0), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        mask = self.allowed(units, paths) if self.allowed else None
        for j in range(self.bins.shape[1]):
            at, b, gain = self._edges(node if mask is None else np.where(mask[node, j], node, -1), j, total)
            if not len(at):
                continue
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            top = np.maximum.reduceat(gain, starts)
            place = np.minimum.reduceat(np.where(gain == np.repeat(top, np.diff([*starts, len(at)])), np.arange(len(at)), len(at)), starts)
            better = top > best[at[starts]]
            to, place = at[starts][better], place[better]
            best[to], feature[to], cut[to] = top[better], j, b[place]
        return best, feature, cut

    def _by_level(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        units, paths, leaves = np.arange(self.units), np.ones(self.units, np.int64), np.ones(self.units, np.int64)
        for depth in range(self.o.depth + 1):
            total = self._sums(node, len(units))
            split = np.zeros(len(units), bool)
            if depth < self.o.depth:
                gain, feature, cut = self._splits(node, total, units, paths)
                split = gain > 0
                # the budget of leaves goes to the largest gains of each unit
                order = np.lexsort((np.arange(len(units)), -gain, units))
                rank = np.arange(len(units)) - np.concatenate([[0], np.cumsum(np.bincount(units, minlength=self.units))])[units[order]]
                split[order] &= rank < (self.o.leaves - leaves)[units[order]]
                leaves += np.bincount(units[split], minlength=self.units)
            worth = total[0] / np.maximum(total[1] + self.o.ridge, 1e-300)[:, None]
            rows = np.flatnonzero(node >= 0)
            done = rows[~split[node[rows]]]
            value[done] = worth[node[done]]
            if not split.any():
                return value
            go = rows[split[node[rows]]]
            right = self.bins[go, feature[node[go]]] > cut[node[go]]
            number = np.cumsum(split) - 1
            now = np.full(len(node), -1)
            now[go] = 2 * number[node[go]] + right
            node = now
            units, paths = np.repeat(units[split], 2), (2 * np.repeat(paths[split], 2)) + np.tile([0, 1], int(split.sum()))
        return value

    def _by_leaf(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        units, paths, depth = np.arange(self.units), np.ones(self.units, np.int64), np.zeros(self.units, np.int64)
        total = self._sums(node, self.units)
        gain, feature, cut = self._splits(node, total, units, paths)
        for _ in range(self.o.leaves - 1):
            # the open leaf with the largest gain of each unit; the first of equals
            order = np.lexsort((np.arange(len(units)), -gain, units))
            order = order[np.concatenate([[True], units[order][1:] != units[order][:-1]])]
            pick = order[gain[order] > 0]
            if not len(pick):
                break
            new = np.full(len(units), -1)
            new[pick] = np.arange(len(pick))
            rows = np.flatnonzero(new[node] >= 0)
            was = node[rows]
            child = np.full(len(node), -1)
            child[rows] = 2 * new[was] + (self.bins[rows, feature[was]] > cut[was])
            u, p, d = np.repeat(units[pick], 2), 2 * np.repeat(paths[pick], 2) + np.tile([0, 1], len(pick)), np.repeat(depth[pick] + 1, 2)
            own = self._sums(child, len(u))
            a, f, c = self._splits(child, own, u, p)
            a[d >= self.o.depth] = 0.0
            node[rows] = len(units) + child[rows]
            gain[pick] = 0.0
            units, paths, depth = np.concatenate([units, u]), np.concatenate([paths, p]), np.concatenate([depth, d])
            gain, feature, cut = np.concatenate([gain, a]), np.concatenate([feature, f]), np.concatenate([cut, c])
            total = tuple(np.concatenate([x, y]) for x, y in zip(total, own, strict=True))
        return (total[0] / np.maximum(total[1] + self.o.ridge, 1e-300)[:, None])[node]

    def _symmetric(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        for _ in range(self.o.depth):
            ids, node = np.unique(node, return_inverse=True)  # the nodes that hold rows, numbered by unit
            units = np.full(len(ids), -1)
            units[node] = self.unit
            total = self._sums(node, len(ids))
            mask = self.allowed(units, np.ones(len(units), np.int64)) if self.allowed else None
            best, feature, cut = np.zeros(self.units), np.full(self.units, -1), np.zeros(self.units, np.int64)
            width = int(self.bins.max()) + 1
            for j in range(self.bins.shape[1]):
                at, b, gain = self._edges(node if mask is None else np.where(mask[node, j], node, -1), j, total)
                # a node's left part stays the same from one of its bins to the next, so its gain holds up to its next edge
                steps = np.diff(np.concatenate([[0.0], np.maximum(gain, 0)])) if len(at) else gain
                if not len(at):
                    continue
                start = np.concatenate([[True], at[1:] != at[:-1]])
                steps[start] = np.maximum(gain, 0)[start]
                table = np.bincount(units[at] * width + b, steps, self.units * width)
                high = np.zeros(len(ids), np.int64)
                rows = np.flatnonzero(self.live)
                np.maximum.at(high, node[rows], self.bins[rows, j])
                ends = np.flatnonzero(np.concatenate([at[1:] != at[:-1], [True]]))
                table -= np.bincount(units[at[ends]] * width + high[at[ends]], np.maximum(gain, 0)[ends], self.units * width)
                sums = np.cumsum(table.reshape(self.units, width), 1).round(DIGITS)
                pick = sums.argmax(1)
                top = sums[np.arange(self.units), pick]
                better = top > best
                best[better], feature[better], cut[better] = top[better], j, pick[better]
            if (feature < 0).all():
                break
            right = (feature[self.unit] >= 0) & (self.bins[np.arange(len(node)), np.maximum(feature[self.unit], 0)] > cut[self.unit])
            node = 2 * node + right
        ids, node = np.unique(node, return_inverse=True)
        g, h, _ = self._sums(node, len(ids))
        return (g / np.maximum(h + self.o.ridge, 1e-300)[:, None])[node]


def _some_columns(seeds: np.ndarray, count: int, keep: int):
    """A mask of ``keep`` of ``count`` features by hash, for (unit, path) of nodes."""

    def allowed(units: np.ndarray, paths: np.ndarray) -> np.ndarray:
        order = np.argsort(mixed(seeds[units][:, None], paths[:, None], np.arange(count)[None]), 1, kind="stable")
        mask = np.zeros((len(units), count), bool)
        np.put_along_axis(mask, order[:, :keep], True, 1)
        return mask

    return allowed


def boosted(fits: list[Fit], o: Boosting) -> list[np.ndarray]:
    """Class probabilities (rows of ``rest``, classes) of gradient boosting with second derivatives, for each fit."""
    b = _Block(fits, o.bins, o.balanced)
    outputs = 1 if b.k == 2 else b.k
    prior = np.zeros((b.fits, b.k))
    np.add.at(prior, (b.fit[b.train], b.y[b.train]), b.weight[b.train])
    prior = np.clip(prior / prior.sum(1, keepdims=True), 1e-12, 1)
    start = np.log(prior[:, 1:] / prior[:, :1]) if outputs == 1 else np.log(prior)
    raw = start[b.fit]
    unit = (b.fit[:, None] * outputs + np.arange(outputs)).ravel()
    trees = _Growth(unit, np.repeat(b.bins, outputs, 0), b.fits * outputs, o)
    hit = (b.y[:, None] == (np.arange(1, 2) if outputs == 1 else np.arange(b.k))).astype(float)
    unit_seed, live = np.repeat(b.seed, outputs), np.repeat(b.train, outputs)
    m = b.bins.shape[1]
    for i in range(o.rounds):
        p = _chances(raw)
        w = b.weight[:, None]
        g, h = (w * (hit - p)).reshape(-1, 1), (w * p * (1 - p)).ravel()
        part = live
        if o.rows < 1:
            part = live & np.repeat(mixed(b.seed[b.fit], i, b.at) < np.uint64(o.rows * 2.0**64), outputs)
        allowed = _some_columns(mixed(unit_seed, i + 1_000_003), m, max(1, int(m * o.columns))) if o.columns < 1 else None
        same_tree = (lambda units, _, f=allowed: f(units, np.ones(len(units), np.int64))) if allowed else None
        raw = raw + o.rate * trees.grow(g, h, part, same_tree).reshape(-1, outputs)
    p = _chances(raw)
    p = np.hstack([1 - p, p]) if outputs == 1 else p
    return [p[(b.fit == i) & ~b.train] for i in range(b.fits)]


def _chances(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bagged(fits: list[Fit], o: Bagging) -> list[np.ndarray]:
    """Class probabilities (rows of ``rest``, classes) of a forest with balanced weights, bootstrap rows and the square root of the features at each node, for each fit."""
    b = _Block(fits, o.bins, True)
    rows = np.flatnonzero(b.train)
    # how often each tree draws each row: draw d of tree t takes the row that a hash points at
    first = np.concatenate([[0], np.cumsum(np.bincount(b.fit))])[:-1]
    t = np.arange(o.trees)[None, :]
    drawn = first[b.fit[rows]][:, None] + (mixed(b.seed[b.fit[rows]][:, None], t, b.at[rows][:, None]) % b.n[b.fit[rows]][:, None].astype(np.uint64)).astype(np.int64)
    times = np.bincount((drawn * o.trees + t).ravel(), minlength=len(b.fit) * o.trees).reshape(-1, o.trees)
    row, tree = np.nonzero((times > 0) | ~b.train[:, None])
    live, weight = b.train[row], b.weight[row] * times[row, tree]
    unit = b.fit[row] * o.trees + tree
    m = b.bins.shape[1]
    seeds = mixed(np.repeat(b.seed, o.trees), np.tile(np.arange(o.trees), b.fits), 7)
    g = weight[:, None] * (b.y[row][:, None] == np.arange(b.k))
    leaf = _Growth(unit, b.bins[row], b.fits * o.trees, o).grow(g, weight, live, _some_columns(seeds, m, max(1, int(np.sqrt(m)))))
    total = np.zeros((len(b.fit), b.k))
    rest = ~live
    np.add.at(total, row[rest], leaf[rest])
    p = total / o.trees
    return [p[(b.fit == i) & ~b.train] for i in range(b.fits)]
