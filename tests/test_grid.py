"""Windows tuned and deployed in chunks, nested champions, and sweeps with a log, against plain loops."""

import collections
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordline.operators import grid, sweep, trees, tune
from fjordline.plans import catalogue

FEATURES = ["x1", "x2", "x3"]


def panel(spark, n=170, runs=2, classes=2):
    rng = np.random.default_rng(classes)
    data = []
    for r in range(runs):
        x = rng.standard_normal((n + 7 * r, 3))
        z = x @ [1.0, -0.5, 0.2] + rng.logistic(size=len(x)) * 0.3
        y = np.digitize(z, [0] if classes == 2 else [-0.5, 0.5])
        data += [(f"r{r}", datetime.date(2020, 1, 1) + datetime.timedelta(i), int(y[i]), float(z[i]), *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(data, "run string, dt date, y int, forward_r double, x1 double, x2 double, x3 double")
    return grid.numbered(df, ["run"]), {r: [d for d in data if d[0] == r] for r in sorted({d[0] for d in data})}


def fitted(rows, at, one, name, k, spec):
    x, y = np.array([r[4:] for r in rows], float), np.array([r[2] for r in rows])
    a, b = at
    labels, own = np.unique(y[a : b - spec.purge], return_inverse=True)
    u, v = grid.components(x[a : b - spec.purge], x[one], k)[:2] if k else grid.prepare(x[a : b - spec.purge], x[one])
    return labels, grid.learner(name)([trees.Fit(u.round(9), own, v.round(9), 1)])[0], y[one]


@pytest.mark.parametrize(("spec", "k", "classes"), [
    (grid.BatchSpec(train=60, test=20, size=10, cap=100, batches_a_chunk=2), 0, 2),
    (grid.BatchSpec(train=60, test=20, size=10, cap=90, purge=3, batches_a_chunk=3), 2, 3),
    (grid.BatchSpec(train=50, validation=20, test=10, size=15, forecasts=1, cap=80, batches_a_chunk=1), 0, 2),
])
def test_batches_equal_loops(spark, spec, k, classes):
    df, by_run = panel(spark, classes=classes)
    names = ["LogReg C=1.0", "LogReg C=0.25"]
    got = {(r.run, r.batch, r.variant): (r.val_acc, r.acc) for r in grid.score_batches(df, FEATURES, names, spec, ["run"], k).collect()}
    want = {}
    for run, rows in by_run.items():
        for batch, t in enumerate(range(spec.window, len(rows) - spec.ahead + 1, spec.size)):
            a = t - spec.window
            for name in names:
                labels, p, y = fitted(rows, (a, a + spec.train), slice(a + spec.train, t), name, k, spec)
                hit = labels[p.argmax(1)] == y
                want[run, batch, name] = (hit[: spec.validation].mean() if spec.validation else None, hit[spec.validation :].mean())
    assert got.keys() == want.keys() and all(abs(got[x][1] - want[x][1]) < 1e-9 and (got[x][0] or 0) == pytest.approx(want[x][0] or 0) for x in want)
    chosen = spark.createDataFrame([(r, b, names[b % 2]) for r, b, _ in want if b != 1], "run string, batch long, champion string").distinct()
    made = {(r.run, str(r.dt)): r for r in grid.deploy_batches(df, FEATURES, chosen, spec, ["run"], k).collect()}
    count = 0
    for run, rows in by_run.items():
        for batch, t in enumerate(range(spec.window, len(rows) - spec.ahead + 1, spec.size)):
            for step in range(t, t + spec.ahead) if batch != 1 else ():
                labels, p, _ = fitted(rows, (max(0, step - spec.cap), step), slice(step, step + 1), names[batch % 2], k, spec)
                r = made[run, str(rows[step][1])]
                assert r.labels == labels.tolist() and np.allclose(r.p, p[0], atol=1e-7) and (r.batch, r.y, r.variant) == (batch, rows[step][2], names[batch % 2])
                count += 1
    assert count == len(made)


def test_families_compete(spark):
    df, _ = panel(spark, runs=1)
    spec = grid.BatchSpec(train=60, test=20, size=10, cap=80)
    scores = grid.score_batches(df, FEATURES, tune.names("faster"), spec, ["run"])
    assert {r.variant for r in scores.collect()} == set(tune.names("faster"))
    assert scores.groupBy("variant").agg(F.avg("acc").alias("a")).where("a < 0.7").isEmpty()
    assert [len(tune.names(f)) for f in ("faster", "fast", "all", "xgb", "lgbm")] == [3, 15, 19, 2, 2]
    every = {n: grid.learner(n) for n in tune.names("all")}
    assert len(every) == 19


def test_multinomial_has_no_slope_left():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 2))
    y = np.digitize(x[:, 0] + rng.logistic(size=300), [-0.7, 0.7])
    z = np.hstack([np.ones((300, 1)), x])
    for c in (None, 1.0, 0.25):
        w = grid.multinomial(x, y, 3, c)
        n = np.bincount(y)
        weight = np.ones(300) if c is None else c * 300 / (3 * n[y])
        slope = z.T @ (weight[:, None] * (grid.softmax(z @ w) - np.eye(3)[y])) + (0 if c is None else np.vstack([np.zeros(3), w[1:]]))
        assert np.abs(slope).max() < 1e-5


def nested_by_hand(scores):
    out, last = {}, {}
    for (run, batch), rows in sorted(scores.items()):
        of = {}
        for i, name, val, acc in sorted(rows):
            f = name.split()[0]
            if f not in of or val > of[f][0]:
                of[f] = (val, name, acc)
        best = None
        for _, name, acc in of.values():
            if best is None or acc > best[1]:
                best = (name, acc)
        acc_of = {name: acc for _, name, _, acc in rows}
        keep = last.get(run)
        last[run] = keep if keep in acc_of and acc_of[keep] >= best[1] - 1e-15 else best[0]
        out[run, batch] = (*best, last[run])
    return out


def test_champions_over_blocks(spark):
    """Runs longer than a block of the fold, ties, and champions that a batch doesn't score."""
    rng = np.random.default_rng(8)
    names = ["LogReg C=1.0", "LogReg C=4.0", "HGB a", "RF a", "RF b"]
    scores = collections.defaultdict(list)
    for run, n in (("a", 200), ("b", 64), ("c", 65), ("d", 1)):
        for batch in range(n):
            for i, name in enumerate(names):
                if rng.random() < 0.9 or i == 0:
                    scores[run, batch * 2].append((i, name, float(rng.integers(0, 4)), float(rng.integers(0, 4))))
    df = spark.createDataFrame([(r, b, *s) for (r, b), rows in scores.items() for s in rows], "run string, batch long, ordinal int, variant string, val_acc double, acc double")
    got = {(r.run, r.batch): (r.best, r.best_acc, r.champion) for r in tune.nested_champions(df).collect()}
    assert got == nested_by_hand(scores)
    loose = {(r.run, r.batch): r.champion == r.best for r in tune.nested_champions(df, sticky=False).collect()}
    assert len(loose) == len(scores) and all(loose.values())
    assert tune.nested_champions(df.where("false")).count() == 0


def test_newest_forecasts_say_why_not(spark):
    df, by_run = panel(spark, n=120, runs=3)
    top = F.max("dt").over(grid.Window.partitionBy("run"))
    rows = df.withColumns({"newest": F.col("dt") == top, "champion": F.when(F.col("run") == "r1", "other").otherwise("LogReg C=1.0")}).withColumn("y", F.when(~F.col("newest"), F.when(F.col("run") == "r2", 1).otherwise(F.col("y"))))
    got = {r.run: r for r in grid.forecast_newest(rows, FEATURES, ["run"], 100).collect()}
    assert got["r0"].status == "ok" and got["r0"].n_train == 100 and abs(sum(got["r0"].p) - 1) < 1e-9 and str(got["r0"].labelled_through) == str(by_run["r0"][-2][1])
    assert got["r1"].status == "chosen_variant_not_in_grid:other" and got["r2"].status == "training_labels_single_class"
    few = grid.forecast_newest(rows.where("rn > 90"), FEATURES, ["run"]).collect()
    assert all(r.status.startswith("too_few_labeled_rows") for r in few)


def test_failed_groups_are_rows(spark):
    df, _ = panel(spark, n=100, runs=2)
    rows = df.withColumns({"is_test": F.col("rn") >= 80, "y": F.when(F.col("run") == "r1", 1).otherwise(F.col("y"))})
    got = grid.fit_classes(rows, FEATURES, ["Logistic", "Boosted bins"], ["run"])
    assert {(r.run, r.model, r.status) for r in got.collect()} == {("r0", "Logistic", "ok"), ("r0", "Boosted bins", "ok"), ("r1", "Logistic", "one class or no test rows"), ("r1", "Boosted bins", "one class or no test rows")}


def test_classes_not_seen_have_no_chance(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0, 2]), ([0.1, 0.2, 0.7], [0, 1, 2])], "p array<double>, labels array<int>")
    assert [r.q for r in df.select(grid.of_classes("p", "labels", 3).alias("q")).collect()] == [[0.2, 0.0, 0.8], [0.1, 0.2, 0.7]]


# --- sweeps


def test_sweep_writes_each_run_once(spark, tmp_path):
    folder = f"file://{tmp_path}/sweep"
    plan = sweep.planned(spark.createDataFrame([("a",), ("b",)], "instrument string"), leads=(1, 2))
    assert plan.count() == 16 and plan.select("run").distinct().count() == 16 and "a|ternary|high_low|2" in {r.run for r in plan.collect()}
    calls = []

    def evaluate(part, save):
        calls.append(part.count())
        stored = save("steps", part.select("run", F.explode(F.sequence(F.lit(1), F.col("lead"))).alias("i")))
        save("runs", part.join(stored.groupBy("run").count(), "run"))

    def killed(part, save):
        save("steps", part.select("run", F.lit(99).alias("i")))
        raise RuntimeError("lost")

    assert sweep.run_sweep(plan, evaluate, folder, runs_at_once=5, starts=1) == 5
    with pytest.raises(RuntimeError):
        sweep.run_sweep(plan, killed, folder, runs_at_once=5)
    assert sweep.run_sweep(plan, evaluate, folder, runs_at_once=5) == 11 and calls == [5, 5, 5, 1]
    assert sweep.run_sweep(plan, evaluate, folder) == 0
    steps, runs = sweep.results(spark, folder, "steps"), sweep.results(spark, folder, "runs")
    assert steps.where("i = 99").isEmpty() and steps.count() == 24 and runs.count() == 16 and runs.select("run").distinct().count() == 16
    # a second start that did the same runs at the same time
    log = spark.read.parquet(f"{folder}/log")
    log.limit(3).withColumns({"attempt": F.lit("b-late"), "finished": F.col("finished") + F.expr("interval 1 hour")}).write.mode("append").parquet(f"{folder}/log")
    plan.select("run", F.lit(5).alias("i")).write.parquet(f"{folder}/steps/attempt=b-late")
    assert sweep.results(spark, folder, "steps").count() == 24 and sweep.finished(spark, folder).where("elapsed_sec >= 0").count() == 16


def test_queries_from_fitted_sweeps(spark, sf_dir):
    rows = catalogue.QUERIES["daily_signals"](spark, sf_dir).collect()
    assert rows == sorted(rows, key=lambda r: (-r.acc, -(r.sharpe if r.sharpe is not None else -1e9), r.run))
    for r in rows:
        assert r.acc >= 0.5 and r.target_date > r.data_through >= r.labelled_through and r.run.split("|")[1:3] == ["binary", "close"]
        assert r.forecast_error or (abs(r.p_sell + r.p_buy - 1) < 1e-5 and r.position == ("long" if r.pred == 1 else "short") and r.recommendation.endswith("Buy" if r.pred == 1 else "Sell"))
