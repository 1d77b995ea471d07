"""A radial-kernel machine and a perceptron for one small fit each: numpy helpers of ``grid.MODELS``, which deals the fits over tasks."""

from __future__ import annotations

import numpy as np

from .trees import Fit, mixed

#: The radial machine: penalty, stopping tolerance of the dual, and folds whose margins the probabilities are fitted to.
PENALTY, TOLERANCE, FOLDS = 1.0, 1e-3, 5
#: The perceptron: hidden layers, epochs at most, rows a step, step size, ridge, share of validation rows, epochs without gain and least gain.
LAYERS, EPOCHS, STEP, RATE, RIDGE, VALIDATION, PATIENCE, LEAST_GAIN = (128, 64), 400, 200, 1e-3, 1e-4, 0.1, 10, 1e-4


def radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def dual(gram: np.ndarray, y: np.ndarray, most: np.ndarray, tolerance: float = TOLERANCE, rounds: int = 200_000) -> tuple[np.ndarray, float]:
    """(signed weights, offset) that minimise 0.5 a'Qa - sum(a), 0 <= a <= ``most``, y'a = 0: two coordinates at a time, the one that violates most and the partner that gains most."""
    a, slope = np.zeros(len(y)), -np.ones(len(y))
    diagonal = gram.diagonal()
    for _ in range(rounds):
        value = -y * slope
        up, low = np.where(y > 0, a < most, a > 0), np.where(y > 0, a > 0, a < most)
        i = int(np.where(up, value, -np.inf).argmax())
        gap = value[i] - np.where(low, value, np.inf)
        if gap.max() < tolerance:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * gram[i], 1e-12)
        j = int(np.where(gap > 0, gap * gap / curve, -np.inf).argmax())
        # along the line that keeps y'a
        step = gap[j] / curve[j]
        step = min(step, most[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else most[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        slope += step * y * (gram[i] - gram[j])
    value = -y * slope
    free = (a > 0) & (a < most)
    up, low = np.where(y > 0, a < most, a > 0), np.where(y > 0, a > 0, a < most)
    offset = value[free].mean() if free.any() else (value[up].max() + value[low].min()) / 2
    return a * y, float(offset)


def curve(margins: np.ndarray, hit: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, offset) of the logistic curve over margins, with targets drawn in by one observation a class."""
    n1, n0 = hit.sum(), (~hit).sum()
    t = np.where(hit, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([margins, np.ones(len(margins))], 1), np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    loss = lambda w: float((np.logaddexp(0, x @ w) - t * (x @ w)).sum())
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-12)[:, None]) + 1e-10 * np.eye(2), x.T @ (p - t))
        scale = 1.0
        while (after := loss(w - scale * step)) > now and scale > 1e-8:
            scale /= 2
        if now - after < 1e-10:
            break
        w, now = w - scale * step, after
    return float(w[0]), float(w[1])


def _two_sided(f: Fit, c: int, gamma: float, penalty: float) -> np.ndarray:
    """Chances of class ``c`` against the rest for the rows to predict."""
    gram, beside = radial(f.x, f.x, gamma), radial(f.rest, f.x, gamma)
    y = np.where(f.y == c, 1.0, -1.0)
    n = np.bincount(f.y)
    most = penalty * len(y) / (np.count_nonzero(n) * n[f.y])
    fold = (mixed(f.seed, np.arange(len(y))) % np.uint64(FOLDS)).astype(int)
    held = np.zeros(len(y))
    for k in range(FOLDS):
        own = np.flatnonzero(fold != k)
        if len(np.unique(y[own])) == 2:
            w, offset = dual(gram[np.ix_(own, own)], y[own], most[own])
            held[fold == k] = gram[np.ix_(fold == k, own)] @ w + offset
    w, offset = dual(gram, y, most)
    slope, base = curve(held, y > 0)
    return 1 / (1 + np.exp(-np.clip(slope * (beside @ w + offset) + base, -35, 35)))


def radial_machine(fits: list[Fit], penalty: float = PENALTY) -> list[np.ndarray]:
    """Class probabilities of balanced radial machines, each class against the rest where there are more than two, from margins on rows that a fit has not seen."""
    out = []
    for f in fits:
        gamma = 1 / (f.x.shape[1] * max(float(f.x.var()), 1e-12))
        classes = int(f.y.max()) + 1
        if classes == 2:
            p = _two_sided(f, 1, gamma, penalty)
            out.append(np.stack([1 - p, p], 1))
        else:
            p = np.stack([_two_sided(f, c, gamma, penalty) for c in range(classes)], 1)
            out.append(p / np.maximum(p.sum(1, keepdims=True), 1e-300))
    return out


def _forward(x: np.ndarray, w: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The layers' outputs, the input first and class probabilities last."""
    out = [x]
    for k, (a, b) in enumerate(w):
        z = out[-1] @ a + b
        out.append(np.maximum(z, 0) if k + 1 < len(w) else np.exp(z - z.max(1, keepdims=True)))
    out[-1] /= out[-1].sum(1, keepdims=True)
    return out


def perceptron(fits: list[Fit], layers: tuple[int, ...] = LAYERS, epochs: int = EPOCHS) -> list[np.ndarray]:
    """Class probabilities of rectified networks trained by Adam, stopped when the accuracy on validation rows no longer grows; the best weights count. Seeded by the fit."""
    out = []
    for f in fits:
        rng, classes = np.random.default_rng(f.seed), int(f.y.max()) + 1
        order = rng.permutation(len(f.y))
        # some validation rows of each class
        seen = np.concatenate([[own for own in order if f.y[own] == c][: max(1, round(VALIDATION * int((f.y == c).sum())))] for c in range(classes)]).astype(int)
        train = np.setdiff1d(np.arange(len(f.y)), seen)
        sizes = (f.x.shape[1], *layers, classes)
        w = [(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), rng.uniform(-1, 1, b) * np.sqrt(6 / (a + b))) for a, b in zip(sizes, sizes[1:], strict=False)]
        mean, square = ([(np.zeros_like(a), np.zeros_like(b)) for a, b in w] for _ in range(2))
        best, best_w, waited, step = -np.inf, w, 0, 0
        for _ in range(epochs):
            rows = rng.permutation(train)
            for start in range(0, len(rows), STEP):
                own, step = rows[start : start + STEP], step + 1
                outs = _forward(f.x[own], w)
                d = (outs[-1] - np.eye(classes)[f.y[own]]) / len(own)
                new = []
                for k in reversed(range(len(w))):
                    grads = (outs[k].T @ d + RIDGE / len(own) * w[k][0], d.sum(0))
                    d = (d @ w[k][0].T) * (outs[k] > 0) if k else d
                    mean[k] = tuple(0.9 * m + 0.1 * g for m, g in zip(mean[k], grads, strict=True))
                    square[k] = tuple(0.999 * s + 0.001 * g * g for s, g in zip(square[k], grads, strict=True))
                    new.append(tuple(x - RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(s) + 1e-8) for x, m, s in zip(w[k], mean[k], square[k], strict=True)))
                w = new[::-1]
            score = float((_forward(f.x[seen], w)[-1].argmax(1) == f.y[seen]).mean())
            waited = 0 if score > best + LEAST_GAIN else waited + 1
            if score > best:
                best, best_w = score, w
            if waited >= PATIENCE:
                break
        out.append(_forward(f.rest, best_w)[-1])
    return out
