"""Moments from running sums against each window by itself."""

import numpy as np

from fjordline.operators import folds, models, moments


def test_windows_equal_svd(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.standard_normal((420, 4)), 0) * [1, 5, 0.1, 2] + [1e4, 0, -3, 50]
    rows = spark.createDataFrame([(r, i, *map(float, x[i] + r)) for r in (0, 1) for i in range(420)], "run int, rn long, a double, b double, c double, d double")
    spec = folds.FoldSpec(window=100, step=7, purge=3)
    sums = moments.running_sums(rows, list("abcd"), ["run"])
    got = moments.components(moments.window_moments(sums, moments.training_windows(rows, spec, ["run"]), ["run"])).collect()
    assert len(got) == 2 * ((420 - 100) // 7 + 1)
    for r in got:
        own = x[r.fold * 7 : r.fold * 7 + 77] + r.run
        assert r.n == 77 and np.allclose(r.mean, own.mean(0), atol=1e-8)
        assert np.allclose(r.cov, np.cov(own, rowvar=False, bias=True)[np.triu_indices(4)], atol=1e-8)
        z = (own - own.mean(0)) / own.std(0)
        s, v = np.linalg.svd(z, full_matrices=False)[1:]
        share = s**2 / (s**2).sum()
        assert np.allclose(r.kept, share, atol=1e-8) and r.k == int(np.searchsorted(np.cumsum(share), 0.95 - 1e-12)) + 1
        assert np.allclose(np.abs((np.array(r.axes) * v).sum(1)), 1, atol=1e-6)


def test_components_alone(spark, sf_dir):
    """The query without the means and covariances (their lambda functions once ended up in a UDF's arguments, which Spark can't evaluate) equals each window by itself."""
    from fjordline.plans import catalogue, model_queries

    got = {(r.instrument, r.fold): (r.n, r.k, r.kept) for r in catalogue.QUERIES["fold_components"](spark, sf_dir).collect()}
    panel = model_queries.panel(spark, sf_dir).orderBy("instrument", "rn").toPandas()
    want = {}
    for name, rows in panel.groupby("instrument"):
        x = rows[model_queries.FEATURES].to_numpy()
        for f in range((len(x) - 250) // 5 + 1 if len(x) >= 250 else 0):
            z = x[f * 5 : f * 5 + 200]
            s = np.linalg.svd((z - z.mean(0)) / z.std(0), compute_uv=False) ** 2
            want[name, f] = s / s.sum()
    assert got and got.keys() == want.keys()
    for at, share in want.items():
        n, k, kept = got[at]
        assert n == 200 and np.allclose(kept, share, atol=2e-6) and k == int(np.searchsorted(np.cumsum(share), 0.95 - 1e-12)) + 1


def test_cumulated_windows_equal_preparation_by_rows():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 4)) * [1, 100, 0.01, 3] + [0, 1e3, 5, 0]
    x[:, 3] = np.where(np.arange(500) < 250, 7.0, x[:, 3])  # constant at first
    sums = moments.Cumulated(x)
    for a, b in ((0, 200), (17, 230), (100, 400), (260, 499), (240, 260)):
        rest = slice(b, b + 1)
        for k in (0, 2, 4):
            want = models.components(x[a:b], x[rest], k)[:2] if k else models.prepare(x[a:b], x[rest])
            assert all(np.allclose(u, v, atol=1e-8) for u, v in zip(sums.prepared(a, b, rest, k), want, strict=True)), (a, b, k)
