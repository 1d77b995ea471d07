"""Endorsement of runs and the daily signal sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import add_business_days

ENDORSE, STRONG = 0.60, 0.65


def gate(runs: DataFrame, least: float = ENDORSE, basis: str | None = None) -> DataFrame:
    acc = F.expr("try_cast(acc AS double)")
    ok = (F.coalesce("error", F.lit("")) == "") & (F.lower("target_mode") == "binary") & (acc >= least)
    return runs.where(ok if basis is None else ok & (F.lower("basis") == basis))


def latest_batch(batches: DataFrame) -> DataFrame:
    w = Window.partitionBy("run").orderBy(F.desc("batch"))
    return batches.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def endorse(runs: DataFrame, batches: DataFrame, least: float = ENDORSE, strong: float = STRONG) -> DataFrame:
    """Gated runs with their latest batch, best first."""
    last = latest_batch(batches).select("run", "champion", "best_acc", "batch")
    out = gate(runs, least).join(last, "run", "left").withColumn("is_strong", F.expr("try_cast(acc AS double)") >= strong)
    return out.orderBy(F.desc("acc"), "instrument", "lead")


def recommendation(pred: Column, acc: Column, strong: float = STRONG) -> Column:
    side = F.when(pred == 1, "Buy").otherwise("Sell")
    return F.when(acc >= max(STRONG, strong), F.concat(F.lit("Strong "), side)).otherwise(side)


def run_summary(combos: DataFrame, steps: DataFrame, rates: DataFrame) -> DataFrame:
    """Every planned run with its accuracy, batches and stability; runs without steps carry an error text."""
    done = steps.groupBy("run").agg(F.avg(F.col("correct").cast("double")).alias("acc"), F.countDistinct("batch").alias("n_batches"), F.count("*").alias("n_steps"))
    out = combos.join(done, "run", "left").join(rates.select("run", "rate"), "run", "left")
    return out.withColumn("error", F.when(F.col("n_steps").isNull(), "no forecasts").otherwise(""))


def unfinished(combos: DataFrame, finished: DataFrame) -> DataFrame:
    """Resume: planned runs that have no finished row yet."""
    return combos.join(finished.select("run"), "run", "left_anti")


def sharpe_of_side(steps: DataFrame, periods: float = 252.0) -> DataFrame:
    """(run, sharpe, n_sharpe) of being long where class 1 is forecast and short elsewhere."""
    v = F.when(F.col("pred") == 1, F.col("forward_r")).otherwise(-F.col("forward_r"))
    return steps.groupBy("run").agg((F.avg(v) / F.nullif(F.stddev_samp(v), F.lit(0.0)) * F.sqrt(F.lit(periods))).alias("sharpe"), F.count(v).alias("n_sharpe"))


def last_champions(chosen: DataFrame) -> DataFrame:
    """(run, champion, best_acc, same_as_previous) of each run's latest batch."""
    w = Window.partitionBy("run").orderBy("batch")
    last = latest_batch(chosen.withColumn("same_as_previous", F.lag("champion").over(w) == F.col("champion")))
    return last.select("run", "champion", "best_acc", F.coalesce("same_as_previous", F.lit(False)).alias("same_as_previous"))


def signal_sheet(runs: DataFrame, chosen: DataFrame, steps: DataFrame, forecasts: DataFrame, through: Column, qualified: DataFrame | None = None, least: float = ENDORSE, strong: float = STRONG) -> DataFrame:
    """The daily sheet, best first: binary runs on the close that pass the gate (and are among ``qualified`` where that is given and not empty), with their latest champion, Sharpe ratio and
    stability, the forecast for the session after ``through`` and the side to take. ``forecasts`` has run, p_sell, p_buy, pred, labelled_through and status; a run whose forecast failed keeps its
    row with the reason."""
    ok = gate(runs.withColumnRenamed("target", "target_mode"), least, "close")
    if qualified is not None and not qualified.isEmpty():
        ok = ok.join(qualified.select("run"), "run", "left_semi")
    out = ok.join(last_champions(chosen), "run", "left").join(sharpe_of_side(steps), "run", "left").join(forecasts, "run", "left")
    known = (F.col("status") == "ok") & F.col("pred").isNotNull()
    out = out.withColumns(
        {
            "recommendation": F.when(known, recommendation(F.col("pred"), F.col("acc"), strong)).otherwise(""),
            "position": F.when(known, F.when(F.col("pred") == 1, "long").otherwise("short")).otherwise(""),
            "forecast_error": F.when(known, "").otherwise(F.coalesce("status", F.lit("no_forecast"))),
            "data_through": through, "target_date": add_business_days(through, 1),
        }
    )
    columns = ["run", "instrument", "lead", "champion", "acc", "sharpe", "n_sharpe", "rate", "best_acc", "same_as_previous", "labelled_through", "data_through", "target_date", "pred", "p_sell", "p_buy", "position", "recommendation", "forecast_error"]
    return out.select(*columns).orderBy(F.desc("acc"), F.desc_nulls_last("sharpe"), "run")
