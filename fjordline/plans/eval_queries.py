"""Queries over folds, predictions, backtests, tuning and selection. Predictions come from rule signals, so both engines agree exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, folds, metrics, prep, select, targets, tune
from . import tables as T
from .panel_queries import R6, r6
from .registry import query

KEYS = ["instrument", "model"]


@query(
    "holdout_split",
    f"WITH {T.signals_sql()}, s AS (SELECT *, count(*) OVER (PARTITION BY instrument, model) AS n FROM sig) SELECT instrument, model, rn >= n // 2 AS is_test, count(*) AS n_rows, min(dt) AS first_dt, max(dt) AS last_dt FROM s GROUP BY 1, 2, 3",
)
def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    df = folds.holdout(folds.with_size(T.signals(spark, sf), tuple(KEYS)))
    return df.groupBy(*KEYS, "is_test").agg(F.count("*").alias("n_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


FOLD_ROWS = """SELECT instrument, fold, k_at >= 200 AS is_test, count(*) AS n_rows, min(dt) AS first_dt, max(dt) AS last_dt FROM folded WHERE model = 'rule3' {where} GROUP BY 1, 2, 3"""


def fold_rows(spark: SparkSession, sf: str, spec: folds.FoldSpec, lead: int = 1) -> DataFrame:
    df = folds.with_size(T.signals(spark, sf, lead).where("model = 'rule3'"))
    return folds.walk_forward(df, spec).groupBy("instrument", "fold", "is_test").agg(F.count("*").alias("n_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query("wf_folds", f"WITH {T.predictions_sql(20)} " + FOLD_ROWS.format(where=""))
def wf_folds(spark: SparkSession, sf: str) -> DataFrame:
    return fold_rows(spark, sf, folds.FoldSpec(step=20))


@query("purged_folds", f"WITH {T.predictions_sql(50, 5)} " + FOLD_ROWS.format(where="AND (k_at >= 200 OR k_at < 196)"))
def purged_folds(spark: SparkSession, sf: str) -> DataFrame:
    return fold_rows(spark, sf, folds.FoldSpec(purge=4), 5)


@query(
    "origin_pools",
    f"""WITH {T.LEVEL}, p AS (SELECT instrument, rn, count(*) OVER w AS n_pool, min(dt) OVER w AS first_dt, max(dt) OVER w AS last_dt FROM level
WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) SELECT instrument, rn AS origin, n_pool, first_dt, last_dt FROM p WHERE rn >= 250 AND (rn - 250) % 20 = 0""",
)
def origin_pools(spark: SparkSession, sf: str) -> DataFrame:
    return folds.origin_pools(T.level(spark, sf), 250, 250, 20)


@query("class_weights", f"WITH {T.predictions_sql()}, t AS (SELECT instrument, fold, y, count(*) AS n_class FROM folded WHERE model = 'rule1' AND k_at < 200 GROUP BY 1, 2, 3) SELECT instrument, fold, y, n_class, round(sum(n_class) OVER w / (count(*) OVER w * n_class), 6) AS weight FROM t WINDOW w AS (PARTITION BY instrument, fold)")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    df = folds.walk_forward(folds.with_size(T.signals(spark, sf).where("model = 'rule1'")), folds.FoldSpec())
    return r6(prep.class_weights(df, ["instrument", "fold"]), "weight")


@query(
    "label_remap",
    f"""WITH {T.LEVEL}, f AS (SELECT instrument, CAST(rn // 5 AS BIGINT) AS fold, CASE WHEN r < -0.005 THEN 0 WHEN r <= 0.005 THEN 1 WHEN r > 0.005 THEN 2 END AS y
  FROM (SELECT *, lead(px, 5) OVER (PARTITION BY instrument ORDER BY dt) / px - 1 AS r FROM level)), d AS (SELECT DISTINCT instrument, fold, y FROM f WHERE y IS NOT NULL)
SELECT instrument, fold, y, CAST(row_number() OVER (PARTITION BY instrument, fold ORDER BY y) - 1 AS INTEGER) AS class FROM d""",
)
def label_remap(spark: SparkSession, sf: str) -> DataFrame:
    df = T.level(spark, sf).withColumn("y", targets.ternary_label(targets.forward_return(5, "px"))).where("y IS NOT NULL")
    return prep.remap_labels(df.withColumn("fold", F.floor(F.col("rn") / 5).cast("long")), ["instrument", "fold"]).select("instrument", "fold", "y", "class")


LONG = f"""{T.predictions_sql()}, base AS (SELECT f.instrument, f.fold, f.dt, f.k_at >= 200 AS is_test, CASE WHEN extract('isodow' FROM f.dt) <> 3 THEN l.px END AS px, f.p1, 7.0::DOUBLE AS flat
  FROM folded f JOIN level l USING (instrument, dt) WHERE f.model = 'rule5'),
long AS (SELECT instrument, fold, dt, is_test, 'px' AS feature, px AS v FROM base UNION ALL SELECT instrument, fold, dt, is_test, 'p1', p1 FROM base UNION ALL SELECT instrument, fold, dt, is_test, 'flat', flat FROM base),
med AS (SELECT instrument, fold, feature, median(v) AS med FROM long WHERE NOT is_test GROUP BY 1, 2, 3),
imputed AS (SELECT l.instrument, l.fold, l.dt, l.is_test, l.feature, coalesce(l.v, m.med) AS v FROM long l JOIN med m USING (instrument, fold, feature) WHERE m.med IS NOT NULL)"""


def long_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = folds.walk_forward(folds.with_size(T.signals(spark, sf).where("model = 'rule5'")), folds.FoldSpec()).select("instrument", "fold", "dt", "is_test", "p1")
    df = df.join(T.level(spark, sf).select("instrument", "dt", "px"), ["instrument", "dt"])
    df = df.withColumns({"px": F.when(F.weekday("dt") != 2, F.col("px")), "flat": F.lit(7.0)})
    return prep.long_form(df, ["instrument", "fold", "dt", "is_test"], ["px", "p1", "flat"])


@query("fold_median_impute", f"WITH {LONG} SELECT instrument, fold, feature, is_test, count(*) AS n_rows, round(sum(v), 2) AS total FROM imputed GROUP BY 1, 2, 3, 4")
def fold_median_impute(spark: SparkSession, sf: str) -> DataFrame:
    df = prep.median_impute(long_rows(spark, sf), ["instrument", "fold"])
    return df.groupBy("instrument", "fold", "feature", "is_test").agg(F.count("*").alias("n_rows"), F.round(F.sum("v"), 2).alias("total"))


@query(
    "fold_standardize",
    f"""WITH {LONG}, st AS (SELECT instrument, fold, feature, avg(v) AS mu, stddev_pop(v) AS sd FROM imputed WHERE NOT is_test GROUP BY 1, 2, 3)
SELECT i.instrument, i.fold, i.feature, i.dt, i.is_test, round((v - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM imputed i JOIN st USING (instrument, fold, feature)""",
)
def fold_standardize(spark: SparkSession, sf: str) -> DataFrame:
    df = prep.standardize(prep.median_impute(long_rows(spark, sf), ["instrument", "fold"]), ["instrument", "fold"])
    return df.select("instrument", "fold", "feature", "dt", "is_test", F.round("v", 6).alias("z"))


@query("stitched_dedup", f"WITH {T.predictions_sql(20)}, s AS (SELECT *, row_number() OVER (PARTITION BY instrument, model, dt ORDER BY fold DESC) AS k FROM preds) SELECT instrument, model, min(dt) AS first_dt, max(dt) AS last_dt, count(*) AS n_rows, count(DISTINCT dt) AS n_days, CAST(sum(fold) AS BIGINT) AS fold_sum FROM s WHERE k = 1 GROUP BY 1, 2")
def stitched_dedup(spark: SparkSession, sf: str) -> DataFrame:
    df = backtest.stitched(T.predictions(spark, sf, 20), KEYS)
    return backtest.stitched_summary(df, KEYS).join(df.groupBy(*KEYS).agg(F.sum("fold").alias("fold_sum")), KEYS)


@query(
    "pooled_accuracy",
    f"""WITH {T.predictions_sql(20)}, c AS (SELECT instrument, model, y, count(*) AS n, sum(CAST(pred = y AS INT)) AS hit FROM preds GROUP BY 1, 2, 3)
SELECT instrument, model, CAST(sum(n) AS BIGINT) AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(avg(hit / n), 6) AS balanced_accuracy FROM c GROUP BY 1, 2""",
)
def pooled_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that several folds test count several times."""
    return r6(metrics.accuracy(T.predictions(spark, sf, 20), KEYS), "accuracy", "balanced_accuracy")


@query("fold_mean_accuracy", f"WITH {T.predictions_sql()}, f AS (SELECT model, instrument, fold, avg(CAST(pred = y AS INT)) AS acc FROM preds GROUP BY 1, 2, 3) SELECT model, round(avg(acc), 6) AS mean_accuracy, count(*) AS n_folds FROM f GROUP BY 1")
def fold_mean_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.accuracy(T.predictions(spark, sf), ["model", "instrument", "fold"])
    return df.groupBy("model").agg(F.round(F.avg("accuracy"), 6).alias("mean_accuracy"), F.count("*").alias("n_folds"))


@query(
    "auc_rank",
    f"""WITH {T.predictions_sql()}, r AS (SELECT instrument, model, y, rank() OVER (PARTITION BY instrument, model ORDER BY p1) + (count(*) OVER (PARTITION BY instrument, model, p1) - 1) / 2 AS rk FROM preds)
SELECT instrument, model, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) AS roc_auc FROM r GROUP BY 1, 2""",
)
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.roc_auc(T.predictions(spark, sf), KEYS), "roc_auc")


@query(
    "logloss_f1",
    f"""WITH {T.predictions_sql()}, c AS (SELECT *, least(greatest(p0, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS c0, least(greatest(p1, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS c1 FROM preds),
g AS (SELECT instrument, model, avg(-ln(CASE WHEN y = 1 THEN c1 ELSE c0 END / (c0 + c1))) AS log_loss, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 1) AS fn FROM c GROUP BY 1, 2)
SELECT instrument, model, round(log_loss, 6) AS log_loss, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM g""",
)
def logloss_f1(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.log_loss_and_f1(T.predictions(spark, sf), KEYS), "log_loss", "f1")


POS = "SELECT instrument, model, dt, position, round(strat, 6) AS strat FROM pos"


@query("positions_binary", f"WITH {T.positions_sql()} {POS}")
def positions_binary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(T.positions(spark, sf).select(*KEYS, "dt", "position", "strat"), "strat")


@query("positions_threshold", f"WITH {T.positions_sql(0.66)} {POS}")
def positions_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return r6(T.positions(spark, sf, 0.66).select(*KEYS, "dt", "position", "strat"), "strat")


@query(
    "positions_ternary",
    f"""WITH {T.predictions_sql()}, q AS (SELECT instrument, model, dt, fold, p0 * 0.8 AS a, 0.2::DOUBLE AS b, p1 * 0.8 AS c, forward_r FROM preds)
SELECT instrument, model, dt, CASE WHEN greatest(a, b, c) < 0.4 THEN 0 WHEN a >= b AND a >= c THEN -1 WHEN b >= c THEN 0 ELSE 1 END AS position FROM q""",
)
def positions_ternary(spark: SparkSession, sf: str) -> DataFrame:
    p = F.array(F.col("p0") * 0.8, F.lit(0.2), F.col("p1") * 0.8)
    return T.predictions(spark, sf).select(*KEYS, "dt", backtest.ternary_position(p, 0.4).alias("position"))


def risk_sql(keys: str, source: str) -> str:
    return f"""eq AS (SELECT *, exp(sum(ln(1 + strat)) OVER (PARTITION BY {keys} ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS equity FROM {source}),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY {keys} ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS d FROM eq),
raw AS (SELECT {keys}, count(*) AS n_obs, avg(strat) AS m, stddev_samp(strat) AS s, stddev_samp(CASE WHEN strat < 0 THEN strat END) AS down, count(*) FILTER (strat < 0) AS nd, min(d) AS dd,
  avg(CASE WHEN position <> 0 THEN CAST(strat > 0 AS INT) END) AS hit, avg(CAST(position <> 0 AS INT)) AS traded FROM dd GROUP BY ALL),
risk AS (SELECT {keys}, n_obs, CASE WHEN n_obs >= 2 THEN m END AS mean_ret, s AS std_ret, CASE WHEN n_obs >= 2 AND s > 1e-15 THEN m / s * sqrt(252) END AS sharpe,
  CASE WHEN n_obs >= 2 THEN pow(1 + m, 252) - 1 END AS ann_return, s * sqrt(252) AS ann_vol, CASE WHEN n_obs >= 2 AND nd >= 2 AND down > 1e-15 THEN m / down * sqrt(252) END AS sortino,
  CASE WHEN n_obs >= 2 THEN dd END AS max_drawdown, CASE WHEN n_obs >= 2 THEN hit END AS hit_rate, CASE WHEN n_obs >= 2 THEN traded END AS pct_traded FROM raw)"""


RISK = f"WITH {T.positions_sql()}, {risk_sql('instrument, model', 'pos')}"
STATS6 = R6(*backtest.STATS)


@query("risk_stats", f"{RISK} SELECT instrument, model, n_obs, {STATS6} FROM risk")
def risk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return r6(backtest.risk_stats(T.positions(spark, sf), KEYS), *backtest.STATS)


@query("risk_stats_threshold", f"WITH {T.positions_sql(0.66)}, {risk_sql('instrument, model', 'pos')} SELECT instrument, model, n_obs, {STATS6} FROM risk")
def risk_stats_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return r6(backtest.risk_stats(T.positions(spark, sf, 0.66), KEYS), *backtest.STATS)


BLOCKS = f"""WITH {T.positions_sql()}, blk AS (SELECT *, CAST((row_number() OVER (PARTITION BY instrument, model ORDER BY dt) - 1) // 60 AS BIGINT) AS block FROM pos),
{risk_sql('instrument, model, block', 'blk')}"""
BLOCK_METRICS = ["sharpe", "mean_ret", "max_drawdown"]


@query("risk_blocks", f"{BLOCKS} SELECT instrument, model, block, n_obs, {STATS6} FROM risk")
def risk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return r6(backtest.block_stats(T.positions(spark, sf), KEYS, 60), *backtest.STATS)


@query(
    "risk_block_summary",
    f"{BLOCKS}, u AS (" + " UNION ALL ".join(f"SELECT instrument, model, '{m}' AS metric, {m} AS v FROM risk WHERE {m} IS NOT NULL" for m in BLOCK_METRICS) + f""")
SELECT instrument, model, metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM u GROUP BY 1, 2, 3""",
)
def risk_block_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = backtest.block_summary(backtest.block_stats(T.positions(spark, sf), KEYS, 60), KEYS, BLOCK_METRICS)
    return r6(out, "mean", "std", "min", "max")


@query("risk_block_flat", f"{BLOCKS} SELECT instrument, model, round(avg(sharpe), 6) AS roll_sharpe_mean, round(coalesce(stddev_samp(sharpe), 0), 6) AS roll_sharpe_std, round(min(sharpe), 6) AS roll_sharpe_min, round(max(sharpe), 6) AS roll_sharpe_max, count(sharpe) AS roll_sharpe_n FROM risk GROUP BY 1, 2")
def risk_block_flat(spark: SparkSession, sf: str) -> DataFrame:
    summary = backtest.block_summary(backtest.block_stats(T.positions(spark, sf), KEYS, 60), KEYS, ["sharpe"])
    return r6(backtest.flat_summary(summary, KEYS, ["sharpe"]), *(f"roll_sharpe_{s}" for s in ("mean", "std", "min", "max")))


@query("equity_curve", f"{RISK} SELECT instrument, model, dt, round(equity, 6) AS equity FROM eq")
def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    return r6(backtest.equity(T.positions(spark, sf), KEYS).select(*KEYS, "dt", "equity"), "equity")


@query("leaderboard", f"{RISK} SELECT instrument, model, n_obs, {STATS6} FROM risk ORDER BY sharpe DESC NULLS LAST, instrument, model LIMIT 5")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """The five best rows: the limit is the report's."""
    return r6(backtest.leaderboard(backtest.risk_stats(T.positions(spark, sf), KEYS), top=5), *backtest.STATS)


@query("best_by_metric", f"{RISK}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY sharpe DESC NULLS LAST, model) AS k FROM risk) SELECT instrument, model, round(sharpe, 6) AS sharpe FROM k WHERE k = 1")
def best_by_metric(spark: SparkSession, sf: str) -> DataFrame:
    stats = backtest.risk_stats(T.positions(spark, sf), KEYS).select("instrument", "model", F.col("sharpe").alias("acc"), F.col("model").alias("ordinal"))
    return tune.best_variant(stats, ["instrument"]).select("instrument", "model", F.round("acc", 6).alias("sharpe"))


@query("ensemble_mean", f"WITH {T.predictions_sql()} SELECT instrument, fold, dt, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1, count(*) AS members, CAST(avg(p1) > avg(p0) AS INTEGER) AS pred FROM preds GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.ensemble_mean(T.predictions(spark, sf), ["instrument", "fold", "dt"]), "p0", "p1").drop("y", "forward_r")


@query(
    "ensemble_weighted",
    f"""WITH {T.predictions_sql()}, a AS (SELECT instrument, fold, model, avg(CAST(pred = y AS INT)) AS w FROM folded WHERE k_at < 200 GROUP BY 1, 2, 3)
SELECT instrument, fold, dt, count(*) AS members, round(sum(w * p0) / sum(w), 6) AS p0, round(sum(w * p1) / sum(w), 6) AS p1 FROM preds JOIN a USING (instrument, fold, model) GROUP BY 1, 2, 3 HAVING sum(w) > 1e-12 AND count(*) >= 2""",
)
def ensemble_weighted(spark: SparkSession, sf: str) -> DataFrame:
    every = folds.walk_forward(folds.with_size(T.signals(spark, sf), ("instrument", "model")), folds.FoldSpec())
    weights = metrics.accuracy(every.where("NOT is_test"), ["instrument", "fold", "model"])
    df = metrics.ensemble_weighted(every.where("is_test"), weights, ["instrument", "fold", "dt"], ["instrument", "fold", "model"])
    return r6(df.select("instrument", "fold", "dt", "members", "p0", "p1"), "p0", "p1")


CHAIN = f"WITH RECURSIVE {T.batches_sql()}"


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    """One row a run and batch; kept, as steps, rates and endorsements all start from it."""
    return tune.champions(T.batches(spark, sf)[0]).persist()


@query("champion_fold", f"{CHAIN} SELECT run, batch, best, round(best_acc, 6) AS best_acc, champion FROM chain")
def champion_fold(spark: SparkSession, sf: str) -> DataFrame:
    return r6(chosen(spark, sf), "best_acc")


RATES = """, pr AS (SELECT *, lag(champion) OVER (PARTITION BY run ORDER BY batch) AS prev, lead(champion) OVER (PARTITION BY run ORDER BY batch) AS nxt FROM chain),
rates AS (SELECT run, count(*) AS n_batches, CAST(sum(CAST(coalesce(prev = champion, false) AS INT)) AS BIGINT) AS same, CASE WHEN count(*) >= 2 THEN sum(CAST(coalesce(prev = champion, false) AS INT)) / (count(*) - 1) END AS rate FROM pr GROUP BY 1)"""


@query("stability_global", f"{CHAIN}{RATES} SELECT run, n_batches, same, round(rate, 6) AS rate FROM rates")
def stability_global(spark: SparkSession, sf: str) -> DataFrame:
    return r6(tune.stability(chosen(spark, sf)), "rate")


@query("stability_variant", f"{CHAIN}{RATES} SELECT run, champion AS variant, count(*) AS batches, count(*) FILTER (nxt = champion) AS pairs, round(CASE WHEN count(nxt) > 0 THEN count(*) FILTER (nxt = champion) / count(nxt) END, 6) AS retention FROM pr GROUP BY 1, 2")
def stability_variant(spark: SparkSession, sf: str) -> DataFrame:
    return r6(tune.variant_stability(chosen(spark, sf)), "retention")


@query(
    "stability_all_runs",
    f"""{CHAIN}{RATES}, v AS (SELECT run, champion AS variant, count(*) AS batches, count(*) FILTER (nxt = champion) AS pairs, CASE WHEN count(nxt) > 0 THEN count(*) FILTER (nxt = champion) / count(nxt) END AS retention FROM pr GROUP BY 1, 2)
SELECT variant, CAST(sum(batches) AS BIGINT) AS batches, CAST(sum(pairs) AS BIGINT) AS pairs, round(avg(retention), 6) AS retention FROM v GROUP BY 1""",
)
def stability_all_runs(spark: SparkSession, sf: str) -> DataFrame:
    v = tune.variant_stability(chosen(spark, sf))
    return v.groupBy("variant").agg(F.sum("batches").alias("batches"), F.sum("pairs").alias("pairs"), F.round(F.avg("retention"), 6).alias("retention"))


STEPS = """, steps AS (SELECT h.run, h.batch, h.rn, h.correct, h.pred, h.forward_r, c.champion FROM hit h JOIN chain c ON c.run = h.run AND c.batch = h.batch AND c.champion = h.variant),
runs AS (SELECT p.run, p.run AS instrument, p.lead, p.target_mode, p.basis, s.acc, s.n_batches, s.n_steps, r.rate, CASE WHEN s.n_steps IS NULL THEN 'no forecasts' ELSE '' END AS error
  FROM (SELECT i AS run, 1 AS lead, 'Binary' AS target_mode, b AS basis FROM (VALUES ('A'), ('N'), ('R'), ('X')) t(i), (VALUES ('close'), ('high_low')) u(b)) p
  LEFT JOIN (SELECT run, avg(correct) AS acc, count(DISTINCT batch) AS n_batches, count(*) AS n_steps FROM steps GROUP BY 1) s ON s.run = p.run LEFT JOIN rates r ON r.run = p.run)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    hit, best = T.batches(spark, sf)[1], chosen(spark, sf)
    return hit.join(best.select("run", "batch", "champion"), ["run", "batch"]).where("variant = champion")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    plan = tune.combos(spark, run=["A", "N", "R", "X"], lead=[1], target_mode=["Binary"], basis=["close", "high_low"]).withColumn("instrument", F.col("run"))
    return select.run_summary(plan, steps(spark, sf), tune.stability(chosen(spark, sf)))


@query("run_summary", f"{CHAIN}{RATES}{STEPS} SELECT run, instrument, lead, target_mode, basis, round(acc, 6) AS acc, n_batches, n_steps, round(rate, 6) AS rate, error FROM runs")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(runs(spark, sf), "acc", "rate")


LATEST = """, latest AS (SELECT run, champion, best_acc, batch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY batch DESC) AS k FROM chain) WHERE k = 1)"""


@query("endorse", f"{CHAIN}{RATES}{STEPS}{LATEST} SELECT run, basis, lead, round(acc, 6) AS acc, champion, round(best_acc, 6) AS best_acc, batch, acc >= 0.55 AS is_strong FROM runs LEFT JOIN latest USING (run) WHERE error = '' AND lower(target_mode) = 'binary' AND acc >= 0.5")
def endorse(spark: SparkSession, sf: str) -> DataFrame:
    out = select.endorse(runs(spark, sf), chosen(spark, sf), 0.5, 0.55)
    return r6(out.select("run", "basis", "lead", "acc", "champion", "best_acc", "batch", "is_strong"), "acc", "best_acc")


@query("daily_gate_semi", f"{CHAIN}{RATES}{STEPS} SELECT run, basis, round(acc, 6) AS acc FROM runs WHERE error = '' AND lower(target_mode) = 'binary' AND acc >= 0.5 AND lower(basis) = 'close' AND run IN (SELECT run FROM rates WHERE rate >= 0.3)")
def daily_gate_semi(spark: SparkSession, sf: str) -> DataFrame:
    qualified = tune.stability(chosen(spark, sf)).where("rate >= 0.3").select("run")
    return r6(select.gate(runs(spark, sf), 0.5, "close").join(qualified, "run", "left_semi").select("run", "basis", "acc"), "acc")


@query("binary_sharpe", f"{CHAIN}{RATES}{STEPS}, x AS (SELECT run, CASE WHEN pred >= 0.5 THEN forward_r ELSE -forward_r END AS v FROM steps) SELECT run, count(*) AS n, round(avg(v) / stddev_samp(v) * sqrt(252), 6) AS sharpe FROM x GROUP BY 1")
def binary_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    df = steps(spark, sf).withColumn("v", F.when(F.col("pred") >= 0.5, F.col("forward_r")).otherwise(-F.col("forward_r")))
    return df.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("v") / F.stddev_samp("v") * F.sqrt(F.lit(252.0)), 6).alias("sharpe"))


@query(
    "recommendation",
    f"""{CHAIN}{RATES}{STEPS}, l AS (SELECT run, max(rn) AS rn FROM steps GROUP BY 1) SELECT s.run, s.pred, round(r.acc, 6) AS acc,
CASE WHEN r.acc >= 0.65 THEN 'Strong ' ELSE '' END || CASE WHEN s.pred = 1 THEN 'Buy' ELSE 'Sell' END AS recommendation FROM steps s JOIN l ON l.run = s.run AND l.rn = s.rn JOIN runs r ON r.run = s.run AND r.basis = 'close'""",
)
def recommendation(spark: SparkSession, sf: str) -> DataFrame:
    last = steps(spark, sf).groupBy("run").agg(F.max_by("pred", "rn").alias("pred"))
    df = last.join(runs(spark, sf).where("basis = 'close'").select("run", "acc"), "run")
    return df.select("run", "pred", F.round("acc", 6).alias("acc"), select.recommendation(F.col("pred"), F.col("acc")).alias("recommendation"))


@query("diagnostics", f"WITH {T.predictions_sql()}, f AS (SELECT instrument, model, fold, count(DISTINCT y) AS k, avg(pred) AS a FROM preds GROUP BY 1, 2, 3) SELECT CASE WHEN k < 2 THEN 'single_class' WHEN a IN (0, 1) THEN 'constant_forecast' ELSE 'ok' END AS status, count(*) AS n FROM f GROUP BY 1")
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    f = T.predictions(spark, sf).groupBy(*KEYS, "fold").agg(F.countDistinct("y").alias("k"), F.avg("pred").alias("a"))
    status = F.when(F.col("k") < 2, "single_class").when(F.col("a").isin(0.0, 1.0), "constant_forecast").otherwise("ok")
    return f.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "f1_macro",
    f"""WITH {T.predictions_sql(20)}, t AS (SELECT instrument, model, CASE WHEN forward_r < -0.005 THEN 0 WHEN forward_r <= 0.005 THEN 1 ELSE 2 END AS y, CASE WHEN p1 < 0.4 THEN 0 WHEN p1 <= 0.6 THEN 1 ELSE 2 END AS pred FROM preds),
s AS (SELECT instrument, model, y AS c, 1 AS is_y, CAST(y = pred AS INTEGER) AS hit FROM t UNION ALL SELECT instrument, model, pred, 0, CAST(y = pred AS INTEGER) FROM t),
k AS (SELECT instrument, model, c, 2 * sum(hit * is_y) / count(*) AS f FROM s GROUP BY 1, 2, 3) SELECT instrument, model, round(avg(f), 6) AS f1 FROM k GROUP BY 1, 2""",
)
def f1_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes: moves beyond half a percent either way against probabilities beyond 0.4 and 0.6."""
    pred = F.when(F.col("p1") < 0.4, 0).when(F.col("p1") <= 0.6, 1).otherwise(2)
    return r6(metrics.f1_macro(T.predictions(spark, sf, 20).withColumns({"y": targets.ternary_label(F.col("forward_r")), "pred": pred}), KEYS), "f1")


@query(
    "result_rows",
    f"""WITH {T.signals_sql()}, h AS (SELECT *, rn >= (count(*) OVER (PARTITION BY instrument, model)) // 2 AS is_test FROM sig),
c AS (SELECT model, instrument, is_test, y, count(*) AS n, sum(CAST(pred = y AS INT)) AS hit FROM h GROUP BY 1, 2, 3, 4),
a AS (SELECT model, instrument, is_test, sum(n) AS n, sum(hit) / sum(n) AS acc, avg(hit / n) AS bal FROM c GROUP BY 1, 2, 3),
f AS (SELECT model, instrument, is_test, 2 * sum(CAST(pred = 1 AND y = 1 AS INT)) / greatest(1, sum(pred) + sum(y)) AS f1 FROM h GROUP BY 1, 2, 3)
SELECT model, instrument, 1 AS lead, 'binary' AS target, CAST(sum(CASE WHEN NOT is_test THEN n END) AS INTEGER) AS n_train, CAST(sum(CASE WHEN is_test THEN n END) AS INTEGER) AS n_test, 1 AS n_features,
  round(max(CASE WHEN NOT is_test THEN acc END), 6) AS train_accuracy, round(max(CASE WHEN is_test THEN acc END), 6) AS test_accuracy, round(max(CASE WHEN NOT is_test THEN bal END), 6) AS train_balanced_accuracy,
  round(max(CASE WHEN is_test THEN bal END), 6) AS test_balanced_accuracy, round(max(CASE WHEN NOT is_test THEN f1 END), 6) AS train_f1, round(max(CASE WHEN is_test THEN f1 END), 6) AS test_f1
FROM a JOIN f USING (model, instrument, is_test) GROUP BY 1, 2""",
)
def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = folds.holdout(folds.with_size(T.signals(spark, sf), tuple(KEYS)))
    out = metrics.result_rows(df, ["model", "instrument"], 1, "binary", 1)
    names = [f"{p}_{m}" for m in ("accuracy", "balanced_accuracy", "f1") for p in ("train", "test")]
    return r6(out.select("model", "instrument", "lead", "target", "n_train", "n_test", "n_features", *names), *names)
