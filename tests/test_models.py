"""Fits, their figures and statuses, and the helpers of the panel."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from fjordline.functions import exprs
from fjordline.operators import features, folds, metrics, models, panel
from fjordline.sources import bars, sinks


def rows(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    y = (x @ [1.0, -0.5, 0.2] + rng.logistic(size=n) > 0).astype(int)
    data = [("a", 0, i >= 200, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", int(y[i]), float(y[i] - 0.5), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(data, "instrument string, fold long, is_test boolean, dt string, y int, forward_r double, x1 double, x2 double, x3 double").withColumn("dt", F.to_date("dt"))


def test_models_are_chosen_by_name(spark):
    assert models.included(None) == models.included([]) == models.included([" "]) == list(models.FITS)
    assert models.included([" Logit ", "other"]) == ["Logit"]
    none = models.fit_models(rows(spark), ["x1", "x2", "x3"], ["other"]).collect()
    assert [(r.status, r.model) for r in none] == [("No models (check models_include)", None)]
    one = models.fit_models(rows(spark).withColumn("y", F.lit(1)), ["x1", "x2", "x3"]).collect()
    assert {r.model for r in one} == set(models.FITS) and all(r.status != "ok" for r in one)


def test_fits_carry_their_figures_and_fill_the_result_row(spark):
    made = models.fit_models(rows(spark), ["x1", "x2", "x3"], k=2)
    assert made.where("status = 'ok'").count() == 300 * len(models.FITS)
    got = {r.model: r.figures for r in made.collect()}
    assert 0 < got["Logit"]["pseudo_r2"] < 1 and abs(got["Logit"]["pseudo_r2"] - got["Probit"]["pseudo_r2"]) < 0.02
    assert got["Global PCA + logistic"]["k"] == 2 and 0.5 < got["Global PCA + logistic"]["explained_variance"] < 1
    out = metrics.result_rows(made, ["model", "instrument"], 1, "binary", 3)
    want = spark.createDataFrame([], sinks.RESULT_ROW)
    assert set(out.columns) == set(want.columns) and {n: t for n, t in out.dtypes} == dict(want.dtypes)
    assert all(r.n_train == 200 and r.n_test == 100 and r.test_accuracy > 0.55 for r in out.collect())


def test_unpenalised_fits_have_no_slope_left():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 3))
    y = (x[:, 0] + rng.logistic(size=400) > 0).astype(float)
    z = np.hstack([np.ones((400, 1)), x])
    w, pseudo = models.unpenalised(x, y)
    assert np.abs(z.T @ (y - 1 / (1 + np.exp(-z @ w)))).max() < 1e-6 and pseudo > 0
    a, b, share = models.components(x, x[:5], 9)
    assert a.shape == (400, 3) and b.shape == (5, 3) and abs(share - 1) < 1e-12 and np.allclose(a.std(0), 1)
    assert models.few_components(20, 60) == 8 and models.few_components(1000, 60) == 40


def garch_cost(r, omega, a, b):
    h, total = float(np.mean(r * r)), 0.0
    for x in r:
        total += np.log(h) + x * x / h
        h = omega + a * x * x + b * h
    return total, h


def test_garch_is_as_likely_as_the_best_of_a_fine_grid():
    """Windows of several lengths side by side, some with no clustering, where the best point lies on the border."""
    rng = np.random.default_rng(7)
    windows = []
    for k, (a, b) in enumerate([(0.1, 0.85), (0.3, 0.5), (0.0, 0.0), (0.05, 0.9), (0.2, 0.2)]):
        h, r = 1.0, []
        for _ in range(130 + 60 * k):
            r.append(rng.normal() * np.sqrt(h))
            h = 0.1 + a * r[-1] ** 2 + b * h
        windows.append(np.array(r))
    q, own = np.ones((400, 5)), np.zeros((400, 5), bool)
    for k, r in enumerate(windows):
        q[: len(r), k], own[: len(r), k] = r * r, True
    made, ahead, cost = features.fit_garch(q, own)
    for k, r in enumerate(windows):
        v = float(np.mean(r * r))
        mine = garch_cost(r, *made[k])
        assert abs(mine[0] - cost[k]) < 1e-6 and abs(mine[1] - ahead[k]) < 1e-6
        grid = min(garch_cost(r, v * s * (1 - a - b), a, b)[0] for a in (0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4) for b in (0, 0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93) if a + b < 0.999 for s in (0.7, 0.85, 1, 1.2))
        assert mine[0] <= grid + 0.01, (k, mine[0], grid)
    x = np.random.default_rng(1).random((60, 3))
    loop = [np.array([1.0, 2.0, 3.0])]
    for row in x:
        loop.append(row + np.array([0.9, 0.1, 0.0]) * loop[-1])
    assert np.allclose(features.carried(x, np.array([0.9, 0.1, 0.0]), loop[0]), loop)


def test_garch_columns_join_the_panel(spark):
    rng = np.random.default_rng(9)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 220)))
    df = spark.createDataFrame([("a", f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(x)) for i, x in enumerate(px)], "instrument string, dt string, close double").withColumn("dt", F.to_date("dt"))
    out = features.with_garch(df).orderBy("dt").collect()
    assert len(out) == 220 and out[50].feat_garch_cond_sigma_pct is None and 0.5 < out[219].feat_garch_cond_sigma_pct < 2 and out[219].feat_garch_realized_vol20_pct > 0


def test_ewma_over_blocks(spark):
    rng = np.random.default_rng(3)
    r = rng.standard_normal(1200)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(r)], "instrument string, i int, ret double").withColumn("dt", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i")))
    got = [x.vol for x in features.ewma_vol(df).orderBy("dt").collect()]
    v, a = r[0] ** 2, 1 - 2 ** (-1 / 60)
    for x, g in zip(r, got):
        v = v if x == r[0] else (1 - a) * v + a * x * x
        assert abs(np.sqrt(v) - g) < 1e-9


def test_panel_helpers(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.0, 2.0, 3.0)] * 50, "instrument string, fund_x double, fund_y double, A_close double, A_rsi double")
    assert panel.columns_like(df, ("fund_", "A_")) == ["fund_x", "fund_y", "A_rsi"]
    assert panel.drop_empty_columns(df, ["fund_x", "fund_y"]).columns == ["instrument", "fund_y", "A_close", "A_rsi"]
    assert panel.kept_columns(df, ["fund_x", "fund_y"]) == ["fund_y"] and panel.kept_columns(df.where("false"), ["fund_y"]) == []
    days = spark.createDataFrame([("2024-03-14",), ("2024-03-15",), ("2024-03-18",)], "d string").select(F.to_date("d").alias("dt"))
    until = lambda t: panel.until_session(days, F.lit(t).cast("timestamp_ntz")).count()
    assert until("2024-03-15 20:00:00") == 1 and until("2024-03-15 21:30:00") == 2 and until("2024-03-16 12:00:00") == 2
    labels = spark.createDataFrame([(" HL ",), ("path",), ("x",), (None,)], "b string").select(exprs.basis_label(F.col("b"))).collect()
    assert [r[0] for r in labels] == ["high_low", "high_low", "close", "close"]
    with gzip.open(tmp_path / "q.csv.gz", "wt") as f:
        f.write("dt,close\n2024-01-02,1.5\n2024-01-03,bad\n2024-01-04,-1\n")
    q = bars.read_quotes_csv(spark, [str(tmp_path / "q.csv.gz")]).where("close > 0")
    assert q.agg(F.max_by("close", "dt")).first()[0] == 1.5
    whole = folds.holdout_as_fold(spark.range(10).select(F.lit(10).alias("n"), F.col("id").alias("rn")))
    assert whole.where("is_test AND fold = 0").count() == 5
    inner = folds.InnerSplit(250, 0.2)
    assert (inner.train, inner.validation, inner.test) == (160, 40, 50)
