import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordline.functions import exprs
from fjordline.operators import backtest, calendar, features, folds, metrics, models, panel, prep, select, targets, tune
from fjordline.sources import bars as B

D = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)


def series(spark, values, name="close", instrument="A"):
    return spark.createDataFrame([(instrument, D(i), v) for i, v in enumerate(values)], f"instrument string, dt date, {name} double")


def column(df, name, order="dt"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_flat_and_missing_returns_have_no_binary_label(spark):
    df = series(spark, [1.0, 1.0, 2.0, None, 0.0]).withColumn("r", targets.forward_return(1))
    assert column(df, "r") == [0.0, 1.0, None, None, None]
    df = df.withColumn("b", targets.binary_label(F.col("r"))).withColumn("t", targets.ternary_label(F.col("r")))
    assert column(df, "b") == [None, 1, None, None, None] and column(df, "t") == [1, 2, None, None, None]


@pytest.mark.parametrize("r, want", [(-0.0051, 0), (-0.005, 1), (0.005, 1), (0.0051, 2), (None, None)])
def test_ternary_band(spark, r, want):
    df = spark.createDataFrame([(r,)], "r double").select(targets.ternary_label(F.col("r")).alias("y"))
    assert df.first().y == want


@pytest.mark.parametrize("hi, lo, r, want", [(0.2, -0.2, -1.0, 1), (0.1, -0.2, 1.0, 0), (0.0, 0.0, 0.1, 1), (0.0, 0.0, 0.0, None), (None, None, None, None)])
def test_path_binary(spark, hi, lo, r, want):
    df = spark.createDataFrame([(hi, lo, r)], "hi double, lo double, r double")
    assert df.select(targets.path_binary(F.col("hi"), F.col("lo"), F.col("r")).alias("y")).first().y == want


def test_excursions_need_the_whole_window(spark):
    rows = [("A", D(i), 1.0 + i, 0.5, 1.0) for i in range(5)]
    rows[2] = ("A", D(2), None, 0.5, 1.0)
    df = targets.excursions(spark.createDataFrame(rows, "instrument string, dt date, high double, low double, close double"), 2)
    assert column(df, "hi_exc") == [None, None, 4.0, None, None]


def test_fill_stops_after_the_limit(spark):
    bars = series(spark, [1.0] * 9)
    ctx = spark.createDataFrame([(D(0), 7.0)], "dt date, ctx double")
    assert column(panel.join_exact_filled(bars, ctx, ["ctx"], ["dt"], 5), "ctx") == [7.0] * 6 + [None] * 3


def test_values_on_other_days_are_lost_or_carried(spark):
    bars = spark.createDataFrame([("A", D(0)), ("A", D(2))], "instrument string, dt date")
    off = spark.createDataFrame([(D(1), 5.0)], "dt date, x double")
    assert column(panel.join_exact_filled(bars, off, ["x"], ["dt"]), "x") == [None, None]
    assert column(panel.join_as_of(bars, off, ["x"]), "x") == [None, 5.0]


def test_later_rows_do_not_change_earlier_features(spark):
    values = [10 + math.sin(i) for i in range(60)]
    one = features.realized_vol(features.pct_change(series(spark, values)))
    two = features.realized_vol(features.pct_change(series(spark, values[:40] + [99.0] * 20)))
    assert column(one, "vol")[:40] == column(two, "vol")[:40]
    e1, e2 = (features.ewma_vol(features.pct_change(series(spark, v))) for v in (values, values[:40] + [99.0] * 20))
    assert column(e1, "vol")[:39] == column(e2, "vol")[:39]


def test_ewma_equals_the_recursion(spark):
    r = np.array([1.0, -2.0, 0.5, 3.0])
    df = features.ewma_vol(series(spark, r.tolist(), "ret"), half_life=2)
    a, v, want = 1 - 2 ** (-1 / 2), r[0] ** 2, [abs(r[0])]
    for x in r[1:]:
        v = (1 - a) * v + a * x * x
        want.append(math.sqrt(v))
    assert np.allclose(column(df, "vol"), want)


@pytest.mark.parametrize("n, window, step, share", [(300, 100, 20, 0.8), (253, 52, 50, 0.8), (120, 60, 70, 0.7)])
def test_folds_equal_brute_force(spark, n, window, step, share):
    spec = folds.FoldSpec(window, share, step)
    got = {(r.fold, r.rn, r.is_test) for r in folds.walk_forward(spark.range(n).select(F.col("id").alias("rn"), F.lit(n).alias("n")), spec).collect()}
    want = {(f, s + k, k >= spec.train) for f, s in enumerate(range(0, n - window + 1, step)) for k in range(window)}
    assert got == want


def test_purged_folds_leave_the_last_training_rows_out(spark):
    spec = folds.FoldSpec(60, 0.8, purge=4)
    rows = folds.walk_forward(spark.range(60).select(F.col("id").alias("rn"), F.lit(60).alias("n")), spec)
    assert sorted(r.rn for r in rows.where("NOT is_test").collect()) == list(range(spec.train - 4))


def test_small_folds_are_refused():
    with pytest.raises(ValueError):
        folds.FoldSpec(window=40)


def test_inner_split_sizes():
    s = folds.InnerSplit(100, 0.2, 0.75)
    assert (s.train, s.validation, s.test) == (60, 20, 20)


def test_median_and_scale_come_from_training_rows(spark):
    rows = [(0, False, "a", 1.0), (0, False, "a", 2.0), (0, True, "a", None), (0, False, "b", None), (0, True, "b", 1.0), (0, False, "c", 5.0), (0, True, "c", 6.0)]
    df = spark.createDataFrame(rows, "fold int, is_test boolean, feature string, v double")
    out = prep.median_impute(df, ["fold"])
    assert {(r.feature, r.v) for r in out.where("is_test").collect()} == {("a", 1.5), ("c", 6.0)}
    assert {(r.feature, r.v) for r in prep.standardize(out, ["fold"]).where("is_test").collect()} == {("a", 0.0), ("c", 1.0)}


def test_auc_with_ties_and_one_class(spark):
    rows = [("m", 1, 0.5), ("m", 0, 0.5), ("m", 1, 0.9), ("m", 0, 0.1), ("one", 1, 0.3)]
    out = {r.model: r.roc_auc for r in metrics.roc_auc(spark.createDataFrame(rows, "model string, y int, p1 double"), ["model"]).collect()}
    assert out["m"] == 0.875 and out["one"] is None


def test_positions(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.6, 0.4), (0.49, 0.51)], "p0 double, p1 double")
    assert [r[0] for r in df.select(backtest.binary_position(F.col("p0"), F.col("p1"))).collect()] == [1, -1, 1]
    assert [r[0] for r in df.select(backtest.binary_position(F.col("p0"), F.col("p1"), 0.6)).collect()] == [0, -1, 0]
    t = spark.createDataFrame([([0.4, 0.2, 0.4],), ([0.2, 0.4, 0.4],), ([0.1, 0.2, 0.7],)], "p array<double>")
    assert [r[0] for r in t.select(backtest.ternary_position(F.col("p"))).collect()] == [-1, 0, 1]


def test_risk_edges(spark):
    rows = [("one", D(0), 0.1, 1)] + [("flat", D(i), 0.0, 0) for i in range(3)] + [("dip", D(i), x, 1) for i, x in enumerate((-0.1, 0.2, 0.1))]
    df = spark.createDataFrame(rows, "model string, dt date, strat double, position int")
    out = {r.model: r for r in backtest.risk_stats(df, ["model"]).collect()}
    assert out["one"].mean_ret is None and out["one"].max_drawdown is None
    assert out["flat"].hit_rate is None and out["flat"].pct_traded == 0 and out["flat"].sharpe is None
    assert out["dip"].max_drawdown == 0 and out["dip"].sortino is None  # the peak starts at the first equity; one loss


def test_later_fold_wins_when_stitching(spark):
    df = spark.createDataFrame([("m", D(0), 0, 1), ("m", D(0), 1, 0)], "model string, dt date, fold int, pred int")
    assert [(r.fold, r.pred) for r in backtest.stitched(df, ["model"]).collect()] == [(1, 0)]


def test_champion_is_sticky_on_ties(spark):
    scores = [("r", b, i, v, a) for b, accs in enumerate([(0.5, 0.5), (0.6, 0.6), (0.4, 0.7), (0.7, 0.7)]) for i, (v, a) in enumerate(zip("ab", accs))]
    df = spark.createDataFrame(scores, "run string, batch long, ordinal int, variant string, acc double")
    assert [r.champion for r in tune.champions(df).orderBy("batch").collect()] == ["a", "a", "b", "b"]
    assert [r.champion for r in tune.champions(df, sticky=False).orderBy("batch").collect()] == ["a", "a", "b", "a"]
    s = tune.stability(tune.champions(df)).first()
    assert (s.n_batches, s.same) == (4, 2) and abs(s.rate - 2 / 3) < 1e-12


def test_grids(spark):
    assert [tune.variants(spark, f).count() for f in ("faster", "fast", "all", "logreg")] == [3, 15, 19, 3]
    assert tune.variants(spark, "other", strict=False).count() == 19
    with pytest.raises(ValueError):
        tune.variants(spark, "other")


@pytest.mark.parametrize(
    "now, through, target",
    [
        ("2024-01-05 16:59:00", "2024-01-04", "2024-01-05"), ("2024-01-05 17:00:00", "2024-01-05", "2024-01-08"), ("2024-01-06 12:00:00", "2024-01-05", "2024-01-08"),
        ("2024-01-07 18:00:00", "2024-01-05", "2024-01-08"), ("2024-01-08 09:00:00", "2024-01-05", "2024-01-08"), ("2024-01-08 17:30:00", "2024-01-08", "2024-01-09"),
    ],
)
def test_sessions(spark, now, through, target):
    a, b = calendar.session_dates(F.col("ny"))
    r = spark.createDataFrame([(now,)], "ny string").select(F.to_timestamp_ntz("ny").alias("ny")).select(a.alias("a"), b.alias("b")).first()
    assert (str(r.a), str(r.b)) == (through, target)


def test_new_york_across_the_clock_change(spark):
    r = spark.sql("SELECT timestamp_ntz'2024-03-08 22:00:00' AS a, timestamp_ntz'2024-03-11 21:00:00' AS b").select(*(F.hour(calendar.new_york(F.col(c))) for c in "ab")).first()
    assert tuple(r) == (17, 17)


def test_business_days(spark):
    import pandas as pd

    rows = [(D(i), n) for i in range(14) for n in range(1, 11)]
    df = spark.createDataFrame(rows, "d date, n int").select("d", "n", exprs.add_business_days(F.col("d"), F.col("n")).alias("x"))
    assert all(r.x == (pd.Timestamp(r.d) + pd.offsets.BusinessDay(r.n)).date() for r in df.collect())


def test_gate_and_recommendation(spark):
    runs = spark.createDataFrame([("a", "", "Binary", "close", "0.61"), ("b", "x", "binary", "close", "0.9"), ("c", None, "binary", "high_low", "0.7"), ("d", "", "ternary", "close", "0.7"), ("e", "", "binary", "close", "n/a")], "run string, error string, target_mode string, basis string, acc string")
    assert sorted(r.run for r in select.gate(runs).collect()) == ["a", "c"]
    assert [r.run for r in select.gate(runs, basis="close").collect()] == ["a"]
    df = spark.createDataFrame([(1, 0.66), (0, 0.64), (1, 0.6)], "pred int, acc double")
    assert [r[0] for r in df.select(select.recommendation(F.col("pred"), F.col("acc"))).collect()] == ["Strong Buy", "Sell", "Buy"]


def test_periods(spark):
    df = series(spark, [1.0] * 30)
    assert panel.trim_period(df, "7d").count() == 8 and panel.trim_period(df, "max").count() == 30
    with pytest.raises(ValueError):
        panel.trim_period(df, "soon")


def test_sources(spark, tmp_path):
    assert B.read_or_empty(spark, str(tmp_path / "none")).count() == 0
    assert B.read_endorsed_json(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "q.json").write_text('{"qualified": [{"run": "a", "acc": 0.7}]}')
    assert B.read_endorsed_json(spark, str(tmp_path / "q.json")).first().run == "a"
    empty, full = spark.range(0), spark.range(2)
    assert B.first_non_empty([empty, full]).count() == 2
    q = spark.createDataFrame([("A", 1, None), ("A", 2, 0.0), ("A", 3, 5.0), ("B", 1, float("nan"))], "instrument string, priority int, value double")
    assert [(r.instrument, r.value) for r in B.first_quote(q, ["instrument"]).collect()] == [("A", 5.0)]


def test_newton_equals_gradient_zero():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    w = models.logistic(x, y)
    p, weight = models.chance(x, w), models.balanced(y)
    assert np.abs(x.T @ (weight * (p - y)) + w[1:]).max() < 1e-6


def test_components_keep_the_asked_variance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 2)) @ rng.normal(size=(2, 6))
    a, _ = models.prepare(x, x, 0.95)
    assert a.shape[1] <= 2
