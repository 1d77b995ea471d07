"""Sweeps over all targets, bases and leads, and the daily sheet on top of them.

``sweep_*`` with a SQL twin forecast by the class last known, which both engines agree on exactly; ``sweep_fitted`` and ``daily_signals`` fit models.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import calendar, grid, panel as P, select, sweep, tune
from ..streaming.bars import shared_folder
from . import model_queries as M
from . import tables as T
from .panel_queries import r6
from .registry import query

SPEC = grid.BatchSpec()
LOOKBACK = 1000
#: Gates of the queries, below the defaults: few runs on the given tables are far from a coin's accuracy.
LEAST, STRONG = 0.5, 0.52


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """Levels with the day's prices beside them."""
    return T.level(spark, sf).join(T.daily(spark, sf).select("instrument", "dt", "high", "low", "close"), ["instrument", "dt"])


def plan(df: DataFrame, **axes) -> DataFrame:
    """All instruments of ``df`` and one that has no rows."""
    names = df.select("instrument").distinct()
    return sweep.planned(names.union(df.sparkSession.createDataFrame([("X",)], "instrument string")), **axes)


def by_persistence(df: DataFrame, part: DataFrame, save) -> None:
    """The tables of a part of the plan, every run forecast by its last known class."""
    rows = sweep.labelled(df, []).join(F.broadcast(part.select("run")), "run", "left_semi")
    rows = save("rows", grid.numbered(sweep.last_of_run(rows, LOOKBACK), ["run"]))
    steps = save("steps", sweep.persistence(rows, SPEC.window, SPEC.size))
    chosen = steps.groupBy("run", "batch").agg(F.max("variant").alias("champion"))
    save("runs", sweep.summary(part, rows, steps, tune.stability(chosen), SPEC.window + SPEC.size))


def swept(spark: SparkSession, sf: str) -> str:
    """A folder with the finished sweep: the first start is stopped after a part of the runs, the second goes on."""
    df, folder = priced(spark, sf), shared_folder(spark, "sweep")
    whole = plan(df)
    sweep.run_sweep(whole, lambda part, save: by_persistence(df, part, save), folder, runs_at_once=60, starts=1)
    sweep.run_sweep(whole, lambda part, save: by_persistence(df, part, save), folder)
    return folder


def _labels_sql(level: str, leads: range = range(1, 11)) -> str:
    one = lambda k: (
        f"SELECT instrument, dt, {k} AS lead, lead(px, {k}) OVER o / px - 1 AS r, CASE WHEN count(high) OVER w = {k} AND count(low) OVER w = {k} THEN max(high) OVER w / \"close\" - 1 END AS h,"
        f" CASE WHEN count(high) OVER w = {k} AND count(low) OVER w = {k} THEN min(low) OVER w / \"close\" - 1 END AS l, lead(\"close\", {k}) OVER o / \"close\" - 1 AS c FROM {level}"
        f" WINDOW o AS (PARTITION BY instrument ORDER BY dt), w AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    )
    kinds = {
        ("binary", "close"): "CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN 0 END",
        ("ternary", "close"): "CASE WHEN r < -0.005 THEN 0 WHEN r <= 0.005 THEN 1 WHEN r > 0.005 THEN 2 END",
        ("binary", "high_low"): "CASE WHEN h >= abs(l) AND h > 0 THEN 1 WHEN abs(l) > h AND l < 0 THEN 0 WHEN c > 0 THEN 1 WHEN c < 0 THEN 0 END",
        ("ternary", "high_low"): "CASE WHEN h IS NULL OR l IS NULL THEN NULL WHEN h > 0.005 AND l < -0.005 THEN CASE WHEN h >= abs(l) THEN 2 ELSE 0 END WHEN h > 0.005 THEN 2 WHEN l < -0.005 THEN 0 ELSE 1 END",
    }
    return f"moves AS ({' UNION ALL '.join(one(k) for k in leads)}),\nlab AS ({' UNION ALL '.join(f'''SELECT concat_ws('|', instrument, '{t}', '{b}', lead) AS run, instrument, '{t}' AS target, '{b}' AS basis, lead, dt, {y} AS y, r AS forward_r FROM moves''' for (t, b), y in kinds.items())})"


PRICED = f"""{T.LEVEL}, priced AS (SELECT l.instrument, l.dt, l.px, d.high, d.low, d."close" FROM level l JOIN daily d USING (instrument, dt))"""
SWEPT = f"""{PRICED}, {_labels_sql("priced")},
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY dt DESC) AS k FROM lab WHERE y IS NOT NULL AND forward_r IS NOT NULL) WHERE k <= {LOOKBACK}),
num AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY dt) - 1 AS rn, count(*) OVER (PARTITION BY run) AS n, lag(y, lead) OVER (PARTITION BY run ORDER BY dt) AS pred FROM tail),
steps AS (SELECT *, (rn - 250) // 25 AS batch FROM num WHERE rn >= 250 AND rn < 250 + (n - 250) // 25 * 25 AND pred IS NOT NULL),
plan AS (SELECT concat_ws('|', instrument, target, basis, lead) AS run, * FROM (SELECT DISTINCT instrument FROM priced UNION ALL SELECT 'X') i, (VALUES ('binary'), ('ternary')) t(target), (VALUES ('close'), ('high_low')) b(basis), (SELECT CAST(range AS INTEGER) AS lead FROM range(1, 11)) k),
sizes AS (SELECT run, count(*) AS n_rows, count(DISTINCT y) AS n_classes FROM tail GROUP BY 1), done AS (SELECT run, avg(CAST(y = pred AS INT)) AS acc, count(DISTINCT batch) AS n_batches, count(*) AS n_steps FROM steps GROUP BY 1),
runs AS (SELECT p.*, coalesce(n_rows, 0) AS n_rows, acc, coalesce(n_batches, 0) AS n_batches, coalesce(n_steps, 0) AS n_steps, CASE WHEN n_batches >= 2 THEN 1.0::DOUBLE END AS rate,
  CASE WHEN n_rows IS NULL THEN 'no_rows' WHEN n_rows < 275 THEN 'rolling_batch_too_few_rows' WHEN n_classes < 2 THEN 'one_class' WHEN n_steps IS NULL THEN 'no_forecasts' ELSE '' END AS error FROM plan p LEFT JOIN sizes USING (run) LEFT JOIN done USING (run))"""


@query("sweep_runs", f"WITH {SWEPT} SELECT run, instrument, target, basis, lead, n_rows, round(acc, 6) AS acc, n_batches, n_steps, round(rate, 6) AS rate, error FROM runs")
def sweep_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The run table of the whole sweep, from two starts and one log."""
    out = sweep.results(spark, swept(spark, sf), "runs")
    return r6(out.select("run", "instrument", "target", "basis", "lead", "n_rows", "acc", "n_batches", "n_steps", "rate", "error"), "acc", "rate")


@query("sweep_labels", f"WITH {SWEPT} SELECT run, y, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt, round(avg(forward_r), 6) AS mean_r FROM lab WHERE y IS NOT NULL AND forward_r IS NOT NULL GROUP BY 1, 2")
def sweep_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The classes of every run."""
    out = sweep.labelled(priced(spark, sf), []).groupBy("run", "y").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.avg("forward_r").alias("mean_r"))
    return r6(out, "mean_r")


@query("sweep_endorsed", f"WITH {SWEPT} SELECT run, instrument, lead, basis, round(acc, 6) AS acc, acc >= {STRONG} AS is_strong FROM runs WHERE error = '' AND target = 'binary' AND acc >= {LEAST}")
def sweep_endorsed(spark: SparkSession, sf: str) -> DataFrame:
    """The binary runs of the sweep that pass the gate."""
    folder = swept(spark, sf)
    chosen = sweep.results(spark, folder, "steps").groupBy("run", "batch").agg(F.max("variant").alias("champion")).withColumn("best_acc", F.lit(None).cast("double"))
    runs = sweep.results(spark, folder, "runs").withColumnRenamed("target", "target_mode")
    return r6(select.endorse(runs, chosen, LEAST, STRONG).select("run", "instrument", "lead", "basis", "acc", "is_strong"), "acc")


def clock(df: DataFrame) -> Column:
    """The time (UTC) of the sheet: half past ten in the evening, three days before the newest bar."""
    day = df.agg(F.max("dt").alias("d")).first()["d"]
    return F.lit(datetime.datetime.combine(day - datetime.timedelta(days=3), datetime.time(22, 30)))


def newest_rows(df: DataFrame, features: list[str], leads: tuple[int, ...], now: Column) -> DataFrame:
    """Binary rows on the close of the panel up to the session that ``now`` allows, unlabelled ones included; ``newest`` marks each run's last."""
    rows = sweep.labelled(P.until_session(df, now), features, ("binary",), ("close",), leads, close="px", keep_newest=True)
    return rows.withColumn("newest", F.col("dt") == F.max("dt").over(Window.partitionBy("run")))


SHEET = f"""WITH {SWEPT}, now AS (SELECT (max(dt) - 3)::TIMESTAMP + INTERVAL 22 HOUR + INTERVAL 30 MINUTE AS utc FROM priced),
ny AS (SELECT (utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM now), day AS (SELECT CAST(t AS DATE) AS d, extract('isodow' FROM t) <= 5 AND extract('hour' FROM t) >= 17 AS rolled FROM ny),
ses AS (SELECT CASE WHEN rolled THEN d ELSE d - CASE WHEN extract('isodow' FROM d) = 1 THEN 3 WHEN extract('isodow' FROM d) = 7 THEN 2 ELSE 1 END::INTEGER END AS through FROM day),
cut AS (SELECT p.* FROM priced p, ses WHERE p.dt <= through), {_labels_sql("cut").replace("moves", "moves2").replace("lab AS", "lab2 AS")},
known AS (SELECT run, max(dt) AS labelled_through, max_by(y, dt) AS pred FROM lab2 WHERE y IS NOT NULL AND forward_r IS NOT NULL AND target = 'binary' AND basis = 'close' GROUP BY 1),
sh AS (SELECT run, avg(v) / nullif(stddev_samp(v), 0) * sqrt(252) AS sharpe, count(v) AS n_sharpe FROM (SELECT run, CASE WHEN pred = 1 THEN forward_r ELSE -forward_r END AS v FROM steps) GROUP BY 1),
q AS (SELECT run FROM runs WHERE lead >= 2 AND target = 'binary' AND basis = 'close' AND error = '' AND acc >= {LEAST})
SELECT r.run, r.instrument, r.lead, round(r.acc, 6) AS acc, round(sharpe, 6) AS sharpe, n_sharpe, rate, labelled_through, through AS data_through,
  (through + CASE WHEN extract('isodow' FROM through) = 5 THEN 3 WHEN extract('isodow' FROM through) = 6 THEN 2 ELSE 1 END::INTEGER) AS target_date, pred, CASE WHEN pred = 1 THEN 'long' ELSE 'short' END AS position,
  CASE WHEN r.acc >= 0.65 THEN 'Strong ' ELSE '' END || CASE WHEN pred = 1 THEN 'Buy' ELSE 'Sell' END AS recommendation, '' AS forecast_error
FROM runs r JOIN q USING (run) JOIN known USING (run) JOIN sh USING (run), ses ORDER BY r.acc DESC, sharpe DESC NULLS LAST, r.run"""


@query("daily_sheet", SHEET)
def daily_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The sheet over the swept runs: gate, endorsed runs (leads from 2 on), Sharpe, session dates and order; the newest class known then is the forecast."""
    df, folder = priced(spark, sf), swept(spark, sf)
    runs, steps = sweep.results(spark, folder, "runs"), sweep.results(spark, folder, "steps")
    now = clock(df)
    rows = newest_rows(df, [], sweep.LEADS, now).where("y IS NOT NULL AND forward_r IS NOT NULL")
    known = rows.groupBy("run").agg(F.max("dt").alias("labelled_through"), F.max_by("y", "dt").alias("pred"))
    forecasts = known.withColumns({"p_buy": F.col("pred").cast("double"), "p_sell": 1 - F.col("pred").cast("double"), "status": F.lit("ok")})
    chosen = steps.groupBy("run", "batch").agg(F.max("variant").alias("champion")).withColumn("best_acc", F.lit(None).cast("double"))
    endorsed = select.gate(runs.withColumnRenamed("target", "target_mode"), LEAST).where("lead >= 2")
    through = calendar.session_dates(calendar.new_york(now))[0]
    out = select.signal_sheet(runs, chosen, steps, forecasts, through, endorsed, LEAST, STRONG)
    return r6(out.drop("champion", "best_acc", "same_as_previous", "p_sell", "p_buy"), "acc", "sharpe")


def by_tuning(df: DataFrame, part: DataFrame, save, family: str, spec: grid.BatchSpec = SPEC, k: int = 5) -> None:
    """The tables of a part of the plan from fitted models: variants scored before each batch, sticky champions, every forecast from a fit of its own."""
    rows = sweep.labelled(df, M.FEATURES).join(F.broadcast(part.select("run")), "run", "left_semi")
    rows = save("rows", grid.numbered(sweep.last_of_run(rows, LOOKBACK), ["run"]))
    scores = save("scores", grid.score_batches(rows, M.FEATURES, tune.names(family), spec, ["run"], k))
    chosen = save("batches", tune.champions(scores))
    steps = save("steps", grid.deploy_batches(rows, M.FEATURES, chosen, spec, ["run"], k))
    save("runs", sweep.summary(part, rows, steps, tune.stability(chosen), spec.window + spec.size))


def fitted(spark: SparkSession, sf: str, family: str = "logreg", **axes) -> tuple[DataFrame, str]:
    df, folder = M.feature_panel(spark, sf).join(priced(spark, sf).select("instrument", "dt", "high", "low", "close"), ["instrument", "dt"]), shared_folder(spark, "sweep")
    sweep.run_sweep(plan(df, **axes), lambda part, save: by_tuning(df, part, save, family), folder)
    return df, folder


@query("sweep_fitted")
def sweep_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Run table of the fitted sweep over all targets, bases and leads; logistic variants (two and three classes)."""
    out = sweep.results(spark, fitted(spark, sf)[1], "runs")
    return r6(out, "acc", "rate")


@query("daily_signals")
def daily_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The sheet over fitted binary runs on the close: each gated run's latest champion is fitted on its last 1000 labelled rows and forecasts the session's newest row."""
    df, folder = fitted(spark, sf, target_names=("binary",), bases=("close",))
    runs, steps, chosen = (sweep.results(spark, folder, t) for t in ("runs", "steps", "batches"))
    now = clock(df)
    rows = newest_rows(df, M.FEATURES, sweep.LEADS, now)
    made = grid.forecast_newest(rows.join(select.last_champions(chosen).select("run", "champion"), "run"), M.FEATURES, ["run"], LOOKBACK, 5)
    both = grid.of_classes("p", "labels", 2)
    made = made.withColumns({"p_sell": F.get(both, 0), "p_buy": F.get(both, 1)})
    out = select.signal_sheet(runs, chosen, steps, made, calendar.session_dates(calendar.new_york(now))[0], least=LEAST, strong=STRONG)
    return r6(out, "acc", "sharpe", "rate", "best_acc", "p_sell", "p_buy")
