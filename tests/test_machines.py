"""The radial machine against a projected-gradient solution of its quadratic program, and the perceptron's early stop."""

import numpy as np
import pytest

from fjordline.operators import machines, trees


def fit(seed, n=150, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n + 60, 3))
    y = np.digitize(x[:, 0] ** 2 + x[:, 1] + 0.2 * rng.normal(size=n + 60), np.linspace(0.3, 1.8, classes + 1)[1:-1])
    return trees.Fit(x[:n], y[:n], x[n:], seed), y[n:]


def test_margins_equal_a_quadratic_program():
    f, _ = fit(1, 80)
    gram, y = machines.radial(f.x, f.x, 0.4), np.where(f.y == 1, 1.0, -1.0)
    most = np.where(y > 0, 0.7, 1.9)
    w, offset = machines.dual(gram, y, most, 1e-6)
    q = gram * np.outer(y, y)
    a, step = np.zeros(80), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        a = a - step * (q @ a - 1)
        low, high = -1e3, 1e3  # onto the box and y'a = 0 by bisection
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if y @ np.clip(a - mid * y, 0, most) > 0 else (low, mid)
        new = np.clip(a - mid * y, 0, most)
        if np.abs(new - a).max() < 1e-13:
            break
        a = new
    free = (a > 1e-6) & (a < most - 1e-6)
    b = np.mean((y - gram @ (a * y))[free])
    assert abs(w.sum()) < 1e-9 and np.abs(gram @ w + offset - gram @ (a * y) - b).max() < 1e-3


@pytest.mark.parametrize("classes", [2, 3])
def test_both_learn_and_repeat(classes):
    f, want = fit(2, 400, classes)
    for model in (machines.radial_machine, machines.perceptron):
        p, q = model([f])[0], model([f])[0]
        assert np.array_equal(p, q) and np.allclose(p.sum(1), 1) and (p.argmax(1) == want).mean() > np.bincount(want).max() / len(want) + 0.15


def test_early_stop_keeps_the_best_weights():
    rng = np.random.default_rng(3)
    f = trees.Fit(rng.normal(size=(200, 4)), rng.integers(0, 2, 200), rng.normal(size=(5, 4)), 9)
    whole = machines.perceptron([f], (16,), 400)[0]
    assert any(np.array_equal(whole, machines.perceptron([f], (16,), n)[0]) for n in range(1, 60))
