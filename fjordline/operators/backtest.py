"""From probabilities to positions, returns and risk statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATS = ("mean_ret", "std_ret", "sharpe", "ann_return", "ann_vol", "sortino", "max_drawdown", "hit_rate", "pct_traded")


def stitched(preds: DataFrame, keys: list[str]) -> DataFrame:
    """One row a day: of overlapping folds the later one."""
    w = Window.partitionBy(*keys, "dt").orderBy(F.desc("fold"))
    return preds.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def stitched_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.count("*").alias("n_rows"), F.countDistinct("dt").alias("n_days"))


def binary_position(p0: Column, p1: Column, threshold: float | None = None) -> Column:
    pos = F.when(p1 >= p0, 1).otherwise(-1)
    return pos if threshold is None else F.when(F.greatest(p0, p1) >= threshold, pos).otherwise(0)


def ternary_position(p: Column, threshold: float | None = None) -> Column:
    """``p`` is an array of three probabilities; the first largest decides."""
    best = F.array_position(p, F.array_max(p)) - 1
    pos = F.when(best == 2, 1).when(best == 0, -1).otherwise(0)
    return pos if threshold is None else F.when(F.array_max(p) >= threshold, pos).otherwise(0)


def equity(df: DataFrame, keys: list[str], ret: str = "strat") -> DataFrame:
    """Append the cumulative product of 1 + ret by day."""
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("equity", F.product(F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0))).over(w))


def risk_stats(df: DataFrame, keys: list[str], ret: str = "strat", position: str = "position", periods: float = 252.0) -> DataFrame:
    """One row a key. The drawdown's peak starts at the first equity value; with fewer than two returns all but counts are null."""
    df = equity(df.where(F.col(ret).isNotNull()), keys, ret)
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_dd", F.col("equity") / F.max("equity").over(w) - 1)
    x, traded = F.col(ret), F.abs(F.col(position)) > 1e-12
    raw = df.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.stddev_samp(F.when(x < 0, x)).alias("down"),
        F.count(F.when(x < 0, 1)).alias("n_down"), F.min("_dd").alias("dd"), F.avg(F.when(traded, (x > 0).cast("double"))).alias("hit"), F.avg(traded.cast("double")).alias("traded"),
    )
    two = lambda c: F.when(F.col("n_obs") >= 2, c)
    root = F.sqrt(F.lit(periods))
    return raw.select(
        *keys, "n_obs", two(F.col("m")).alias("mean_ret"), two(F.col("s")).alias("std_ret"), two(F.when(F.col("s") > 1e-15, F.col("m") / F.col("s") * root)).alias("sharpe"),
        two(F.pow(1 + F.col("m"), F.lit(periods)) - 1).alias("ann_return"), two(F.col("s") * root).alias("ann_vol"),
        two(F.when((F.col("n_down") >= 2) & (F.col("down") > 1e-15), F.col("m") / F.col("down") * root)).alias("sortino"),
        two(F.col("dd")).alias("max_drawdown"), two(F.col("hit")).alias("hit_rate"), two(F.col("traded")).alias("pct_traded"),
    )


def block_stats(df: DataFrame, keys: list[str], rows: int, ret: str = "strat") -> DataFrame:
    """Risk statistics of consecutive blocks of ``rows`` rows (the last may be short)."""
    w = Window.partitionBy(*keys).orderBy("dt")
    return risk_stats(df.withColumn("block", F.floor((F.row_number().over(w) - 1) / rows).cast("long")), [*keys, "block"], ret)


def block_summary(blocks: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, std, min, max, n) over blocks where the metric is not null; the deviation of one block is 0."""
    long = blocks.select(*keys, *metrics).unpivot(keys, metrics, "metric", "v").where("v IS NOT NULL")
    return long.groupBy(*keys, "metric").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("n")
    )


def flat_summary(summary: DataFrame, keys: list[str], metrics: list[str], prefix: str = "roll_") -> DataFrame:
    return summary.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{prefix}{m}_{s}") for m in metrics for s in ("mean", "std", "min", "max", "n")))


def leaderboard(stats: DataFrame, by: str = "sharpe", top: int | None = None) -> DataFrame:
    """Best first, nulls last; ties by the remaining key columns."""
    out = stats.orderBy(F.desc_nulls_last(by), *[c for c in ("instrument", "model") if c in stats.columns])
    return out if top is None else out.limit(top)
