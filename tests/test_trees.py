"""Trees grown together against plain recursion, one fit, one tree and one node at a time."""

import numpy as np
import pytest

from fjordline.operators import trees


def fit(seed, n=120, rest=30, classes=2, columns=4, ties=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n + rest, columns))
    x = x.round(1) if ties else x
    y = np.digitize(x[:, 0] * 2 + x[:, 1] ** 2 + rng.normal(size=n + rest), np.linspace(-1, 2, classes + 1)[1:-1])
    y[:classes] = np.arange(classes)
    return trees.Fit(x[:n], y[:n], x[n:], seed)


def coded(f, bins):
    edges = [trees.cuts(f.x[:, j], bins) for j in range(f.x.shape[1])]
    return [np.stack([np.searchsorted(e, m[:, j], "left") for j, e in enumerate(edges)], 1) for m in (f.x, f.rest)]


def balanced(y):
    n = np.bincount(y)
    return len(y) / (np.count_nonzero(n) * n[y])


def best(rows, b, g, h, o, features):
    """(gain, feature, bin): the first feature, then the lowest bin, among equal gains."""
    worth = lambda r: (g[r].sum(0) ** 2).sum() / max(h[r].sum() + o.ridge, 1e-300)
    found = (0.0, None, None)
    for j in features:
        for c in sorted(set(b[rows, j]))[:-1]:
            left, right = rows[b[rows, j] <= c], rows[b[rows, j] > c]
            if min(len(left), len(right)) < o.least_rows or min(h[left].sum(), h[right].sum()) < o.least_hess:
                continue
            gain = round(worth(left) + worth(right) - worth(rows), trees.DIGITS)
            if gain > found[0]:
                found = (gain, j, c)
    return found


def tree(b, rest, g, h, live, o, columns):
    """Leaf values of all rows of ``b`` and of ``rest``; ``columns(path)`` gives the features a node may use."""
    value, value_rest = np.zeros(g.shape), np.zeros((len(rest), g.shape[1]))
    leaves = [(1, 0, np.arange(len(b)), np.arange(len(rest)))]
    done = []

    def parted(leaf, j, c):
        path, depth, rows, others = leaf
        return [(2 * path + side, depth + 1, rows[(b[rows, j] > c) == bool(side)], others[(rest[others, j] > c) == bool(side)]) for side in (0, 1)]

    lived = lambda rows: rows[live[rows]]
    if o.growth == "level":
        for depth in range(o.depth + 1):
            found = [best(lived(x[2]), b, g, h, o, columns(x[0])) if depth < o.depth else (0.0, None, None) for x in leaves]
            order = sorted(range(len(leaves)), key=lambda i: (-found[i][0], i))
            room = o.leaves - len(leaves) - len(done)
            taken = {i for i in order[: max(0, room)] if found[i][0] > 0}
            done += [x for i, x in enumerate(leaves) if i not in taken]
            leaves = [y for i, x in enumerate(leaves) if i in taken for y in parted(x, *found[i][1:])]
        done += leaves
    elif o.growth == "leaf":
        opened = [(x, best(lived(x[2]), b, g, h, o, columns(x[0]))) for x in leaves]
        while len(opened) < o.leaves:
            i = max(range(len(opened)), key=lambda i: (opened[i][1][0], -i))
            leaf, found = opened[i]
            if found[0] <= 0:
                break
            opened[i] = (leaf, (0.0, None, None))
            halves = parted(leaf, *found[1:])
            opened[i : i + 1] = [(leaf, (-1.0, None, None))]
            opened = opened + [(x, best(lived(x[2]), b, g, h, o, columns(x[0])) if x[1] < o.depth else (0.0, None, None)) for x in halves]
            opened = [e for e in opened if e[1][0] >= 0]
        done = [x for x, _ in opened]
    else:
        for _ in range(o.depth):
            found = (0.0, None, None)
            for j in columns(1):
                for c in range(int(b.max()) + 1):
                    total = 0.0
                    for x in leaves:
                        rows = lived(x[2])
                        left, right = rows[b[rows, j] <= c], rows[b[rows, j] > c]
                        if min(len(left), len(right)) >= max(1, o.least_rows) and min(h[left].sum(), h[right].sum()) >= o.least_hess:
                            worth = lambda r: (g[r].sum(0) ** 2).sum() / (h[r].sum() + o.ridge)
                            total += max(0.0, worth(left) + worth(right) - worth(rows))
                    if round(total, trees.DIGITS) > found[0]:
                        found = (round(total, trees.DIGITS), j, c)
            if found[1] is None:
                break
            leaves = [y for x in leaves for y in parted(x, *found[1:])]
        done = leaves
    for _, _, rows, others in done:
        out = g[lived(rows)].sum(0) / max(h[lived(rows)].sum() + o.ridge, 1e-300)
        value[rows], value_rest[others] = out, out
    return value, value_rest


def chosen(seed, count, keep):
    return lambda path: sorted(np.argsort(trees.mixed(seed, path, np.arange(count)), kind="stable")[:keep].tolist())


def boosted_by_hand(f, o):
    b, rest = coded(f, o.bins)
    k = int(f.y.max()) + 1
    w = balanced(f.y) if o.balanced else np.ones(len(f.y))
    outputs = 1 if k == 2 else k
    prior = np.clip([w[f.y == c].sum() / w.sum() for c in range(k)], 1e-12, 1)
    start = np.log(prior[1:] / prior[:1]) if outputs == 1 else np.log(prior)
    raw, raw_rest = np.tile(start, (len(b), 1)), np.tile(start, (len(rest), 1))
    m = b.shape[1]
    chances = lambda z: 1 / (1 + np.exp(-z)) if outputs == 1 else np.exp(z) / np.exp(z).sum(1, keepdims=True)
    for i in range(o.rounds):
        live = np.ones(len(b), bool) if o.rows >= 1 else trees.mixed(f.seed, i, np.arange(len(b))) < np.uint64(o.rows * 2.0**64)
        p, more = chances(raw), []
        for c in range(outputs):
            hit = f.y == (1 if outputs == 1 else c)
            pick = chosen(trees.mixed(np.array([f.seed], np.uint64), i + 1_000_003)[0], m, max(1, int(m * o.columns))) if o.columns < 1 else lambda _: range(m)
            more.append(tree(b, rest, (w * (hit - p[:, c]))[:, None], w * p[:, c] * (1 - p[:, c]), live, o, lambda _, pick=pick: pick(1)))
        raw, raw_rest = raw + o.rate * np.hstack([x for x, _ in more]), raw_rest + o.rate * np.hstack([x for _, x in more])
    p = chances(raw_rest)
    return np.hstack([1 - p, p]) if outputs == 1 else p


def bagged_by_hand(f, o):
    b, rest = coded(f, o.bins)
    k, n, m = int(f.y.max()) + 1, len(f.y), f.x.shape[1]
    total = np.zeros((len(rest), k))
    for t in range(o.trees):
        times = np.bincount((trees.mixed(f.seed, t, np.arange(n)) % np.uint64(n)).astype(int), minlength=n)
        w = balanced(f.y) * times
        seed = trees.mixed(np.array([f.seed], np.uint64), t, 7)[0]
        total += tree(b, rest, w[:, None] * np.eye(k)[f.y], w, times > 0, o, chosen(seed, m, max(1, int(np.sqrt(m)))))[1]
    return total / o.trees


BOOSTING = [
    trees.Boosting(12, 0.1, 4),
    trees.Boosting(6, 0.1, 7, leaves=6, least_rows=5),
    trees.Boosting(8, 0.08, 4, leaves=1 << 30, least_rows=1, least_hess=1.0, ridge=1.0, rows=0.85, columns=0.85, balanced=False),
    trees.Boosting(6, 0.06, 6, growth="leaf", leaves=9, least_rows=5, columns=0.85),
    trees.Boosting(6, 0.06, 3, growth="symmetric", least_rows=1, ridge=3.0, least_hess=0.0),
    trees.Boosting(5, 0.1, 4, bins=16),
]


@pytest.mark.parametrize("options", BOOSTING)
@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_equals_recursion(options, classes):
    fits = [fit(1, classes=classes), fit(2, n=75, rest=1, classes=classes), fit(3, n=140, rest=9, classes=classes, ties=False)]
    for f, p in zip(fits, trees.boosted(fits, options), strict=True):
        assert np.abs(p - boosted_by_hand(f, options)).max() < 1e-9


@pytest.mark.parametrize("classes", [2, 3])
def test_forest_equals_recursion(classes):
    fits, options = [fit(4, classes=classes), fit(5, n=60, rest=3, classes=classes, ties=False)], trees.Bagging(9, 5)
    for f, p in zip(fits, trees.bagged(fits, options), strict=True):
        assert np.abs(p - bagged_by_hand(f, options)).max() < 1e-9 and np.allclose(p.sum(1), 1)


def test_a_fit_does_not_depend_on_its_neighbours():
    fits = [fit(i, n=80 + i) for i in range(6)]
    options = trees.Boosting(5, 0.1, 4, rows=0.8, columns=0.6)
    together = trees.boosted(fits, options)
    assert all(np.abs(trees.boosted([f], options)[0] - p).max() < 1e-9 for f, p in zip(fits, together, strict=True))


def test_learns_what_is_there():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    f = trees.Fit(x[:400], y[:400], x[400:], 1)
    for made in (trees.boosted([f], trees.Boosting(80, 0.1, 4)), trees.bagged([f], trees.Bagging(80, 8)), trees.boosted([f], trees.Boosting(60, 0.1, 6, growth="leaf")), trees.boosted([f], trees.Boosting(60, 0.1, 6, growth="symmetric", least_rows=1, ridge=3.0))):
        assert (made[0].argmax(1) == y[400:]).mean() > 0.9
