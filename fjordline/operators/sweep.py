"""Sweeps over instruments, targets, bases and leads as one plan, written once a run.

The labels of all runs come from one window pass over the panel and are unpivoted to a run key; tuning, forecasts and summaries are keyed by it, so a thousand runs are one Spark job and
not a thousand. Results are kept in a log: an attempt's rows count only once the log names the runs it finished, so a sweep that was killed or started twice has each run once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.bars import read_or_empty
from . import targets

TARGETS, BASES, LEADS = ("binary", "ternary"), ("close", "high_low"), tuple(range(1, 11))
LOG = "run string, attempt string, finished timestamp, elapsed_sec double"


def run_id(instrument: Column, target: Column, basis: Column, lead: Column) -> Column:
    return F.concat_ws("|", instrument, target, basis, lead.cast("string"))


def planned(instruments: DataFrame, target_names: tuple[str, ...] = TARGETS, bases: tuple[str, ...] = BASES, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """(run, instrument, target, basis, lead) of every combination; ``instruments`` has a column of that name."""
    axes = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(b).alias("basis"), F.lit(k).alias("lead")) for t, b, k in product(target_names, bases, leads)))
    df = instruments.select("instrument", F.explode(axes).alias("a")).select("instrument", "a.*")
    return df.select(run_id(F.col("instrument"), F.col("target"), F.col("basis"), F.col("lead")).alias("run"), "instrument", "target", "basis", "lead")


def labelled(panel: DataFrame, features: list[str], target_names: tuple[str, ...] = TARGETS, bases: tuple[str, ...] = BASES, leads: tuple[int, ...] = LEADS, close: str = "px", band: float = targets.BAND, keep_newest: bool = False) -> DataFrame:
    """(run, instrument, target, basis, lead, dt, y, forward_r, features): each row of the panel (instrument, dt, high, low, close, features) once for every run that labels it. With ``keep_newest``
    rows without a label stay."""
    columns = {}
    for k in leads:
        columns[f"_r{k}"] = targets.forward_return(k, close)
        if "high_low" in bases:
            columns |= dict(zip((f"_h{k}", f"_l{k}", f"_c{k}"), targets.excursion_columns(k), strict=True))
    df = panel.withColumns(columns)

    def label(target: str, basis: str, k: int) -> Column:
        r, hi, lo, own = (F.col(f"_{c}{k}") for c in "rhlc")
        if basis == "close":
            return targets.binary_label(r) if target == "binary" else targets.ternary_label(r, band)
        return targets.path_binary(hi, lo, own) if target == "binary" else targets.path_ternary(hi, lo, band)

    made = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(b).alias("basis"), F.lit(k).alias("lead"), label(t, b, k).alias("y"), F.col(f"_r{k}").alias("forward_r")) for t, b, k in product(target_names, bases, leads)))
    rows = df.select("instrument", "dt", F.col(close).alias("px"), F.explode(made).alias("m"), *features).select("instrument", "m.*", "dt", "px", *features)
    rows = rows if keep_newest else rows.where("y IS NOT NULL AND forward_r IS NOT NULL")
    return rows.withColumn("run", run_id(F.col("instrument"), F.col("target"), F.col("basis"), F.col("lead")))


def last_of_run(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each run."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("dt")))).where(F.col("_k") <= n).drop("_k")


def persistence(rows: DataFrame, window: int, size: int) -> DataFrame:
    """(run, batch, variant, dt, y, forward_r, pred): the plainest forecast of a run, the class that was last known (``lead`` rows before), for the rows of complete batches of ``size``
    after the first ``window``. Rows carry rn and n."""
    past = F.collect_list("y").over(Window.partitionBy("run").orderBy("dt").rowsBetween(-max(LEADS), 0))
    df = rows.withColumn("_past", past).withColumn("pred", F.expr("try_element_at(_past, cast(-lead - 1 AS int))"))
    at = F.col("rn") - window
    ok = (at >= 0) & (at < F.floor((F.col("n") - window) / size) * size) & F.col("pred").isNotNull()
    return df.where(ok).select("run", F.floor(at / size).cast("long").alias("batch"), F.lit("Persistence").alias("variant"), "dt", "y", "forward_r", "pred")


def summary(plan: DataFrame, rows: DataFrame, steps: DataFrame, rates: DataFrame, least: int) -> DataFrame:
    """One row a planned run: its rows, classes, mean accuracy, batches, forecasts, champion stability, and an error text where there are no forecasts. ``rows`` are labelled, ``steps`` have
    run, batch, y and pred, ``rates`` run and rate."""
    sizes = rows.groupBy("run").agg(F.count("*").alias("n_rows"), F.countDistinct("y").alias("n_classes"))
    done = steps.groupBy("run").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("acc"), F.countDistinct("batch").alias("n_batches"), F.count("*").alias("n_steps"))
    out = plan.join(sizes, "run", "left").join(done, "run", "left").join(rates.select("run", "rate"), "run", "left")
    n = F.coalesce("n_rows", F.lit(0))
    why = F.when(n == 0, "no_rows").when(n < least, "rolling_batch_too_few_rows").when(F.col("n_classes") < 2, "one_class").when(F.col("n_steps").isNull(), "no_forecasts").otherwise("")
    return out.withColumns({"n_rows": n, "n_batches": F.coalesce("n_batches", F.lit(0)), "n_steps": F.coalesce("n_steps", F.lit(0)), "error": why}).drop("n_classes")


# The log of finished runs.


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(run, attempt, finished, elapsed_sec): the attempt that counts for each finished run, the first that was logged."""
    log = read_or_empty(spark, f"{folder}/log", LOG)
    return log.groupBy("run").agg(F.min(F.struct("finished", "attempt", "elapsed_sec")).alias("f")).select("run", "f.attempt", "f.finished", "f.elapsed_sec")


def results(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of ``table`` for all finished runs, each run's from the one attempt that counts."""
    return spark.read.parquet(f"{folder}/{table}").join(finished(spark, folder).select("run", "attempt"), ["run", "attempt"], "left_semi").drop("attempt")


def run_sweep(plan: DataFrame, evaluate: Callable[[DataFrame, Callable[[str, DataFrame], DataFrame]], None], folder: str, runs_at_once: int = 10_000, starts: int | None = None) -> int:
    """Evaluate all runs of ``plan`` that the log doesn't hold yet, ``runs_at_once`` in one plan (or ``starts`` times that at most), and return how many were. ``evaluate`` gets a part of the plan
    and a function that saves a table with a column ``run`` under the attempt's own name and gives back the stored rows; once it has returned, the log names the runs of the part."""
    spark, count, done = plan.sparkSession, 0, 0
    while starts is None or count < starts:
        names = [r["run"] for r in plan.join(finished(spark, folder).select("run"), "run", "left_anti").select("run").orderBy("run").limit(runs_at_once).collect()]  # short texts
        if not names:
            break
        mine = spark.createDataFrame([(n,) for n in names], "run string")
        attempt, began = f"a-{uuid.uuid4().hex}", time.perf_counter()

        def save(name: str, df: DataFrame, attempt: str = attempt) -> DataFrame:
            path = f"{folder}/{name}/attempt={attempt}"
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        evaluate(plan.join(F.broadcast(mine), "run", "left_semi"), save)
        took = round(time.perf_counter() - began, 3)
        mine.select("run", F.lit(attempt).alias("attempt"), F.current_timestamp().alias("finished"), F.lit(took).alias("elapsed_sec")).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        count, done = count + 1, done + len(names)
    return done
