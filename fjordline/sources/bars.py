"""Bars of instruments: readers, calendar normalisation, today's bar and quote fallbacks.

One long table (instrument, dt, open, high, low, close, volume) stands for all instruments; reading a missing table gives
an empty one with the fixed schema.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clean

BARS = "instrument string, dt date, open double, high double, low double, close double, volume double"


def read_or_empty(spark: SparkSession, path: str, schema: str = BARS) -> DataFrame:
    """A parquet table, or an empty one of ``schema`` where the path does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def first_non_empty(sources: list[DataFrame]) -> DataFrame:
    """Ordered fallbacks: the first table that has a row, else the last."""
    for df in sources[:-1]:
        if not df.isEmpty():
            return df
    return sources[-1]


def to_bars(ticks: DataFrame, keys: list[str], order: Column, price: str, volume: Column) -> DataFrame:
    """One bar a key: open and close are the prices of the least and the largest ``order``, which must be unique in a key."""
    p = F.col(price)
    return ticks.groupBy(*keys).agg(
        F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"),
        F.sum(F.coalesce(volume, F.lit(0.0))).alias("volume"), F.avg(p).alias("mean_price"),
    )


def session_date(ts: str | Column, zone: str = "UTC") -> Column:
    """Calendar day of a UTC time in ``zone``; the time of day is dropped."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")))


def smoothed_level(bars: DataFrame, rows: int = 20) -> DataFrame:
    """(instrument, dt, rn, px): mean of the daily mean price over ``rows`` rows, warm-up dropped, ``rn`` from 0."""
    w = Window.partitionBy("instrument").orderBy("dt")
    df = bars.select("instrument", "dt", F.avg("mean_price").over(w.rowsBetween(1 - rows, 0)).alias("px"), F.row_number().over(w).alias("k"))
    return df.where(F.col("k") > rows).select("instrument", "dt", (F.col("k") - rows - 1).cast("long").alias("rn"), "px")


def upsert_today(history: DataFrame, today: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """History with today's bars put in: one row per (instrument, dt); today's values win where they are not null."""
    both = history.select("instrument", "dt", *columns, F.lit(0).alias("rank")).unionByName(today.select("instrument", "dt", *columns, F.lit(1).alias("rank")))
    latest = {c: F.coalesce(F.max(F.when(F.col("rank") == 1, F.col(c))), F.max(F.when(F.col("rank") == 0, F.col(c)))) for c in columns}
    return both.groupBy("instrument", "dt").agg(*(v.alias(k) for k, v in latest.items()))


def carry_forward(bars: DataFrame, today: Column) -> DataFrame:
    """A bar dated ``today`` from each instrument's last bar: flat at the last close when that bar is older, else its own prices with
    missing ones set to the close."""
    w = Window.partitionBy("instrument").orderBy(F.desc("dt"))
    last = bars.where(clean(F.col("close")).isNotNull()).withColumn("k", F.row_number().over(w)).where("k = 1")
    stale = F.col("dt") < today
    pick = lambda c: F.when(stale, F.col("close")).otherwise(F.coalesce(F.col(c), F.col("close"))).alias(c)
    return last.select("instrument", today.alias("dt"), pick("open"), pick("high"), pick("low"), F.col("close"), F.when(stale, 0.0).otherwise(F.coalesce("volume", F.lit(0.0))).alias("volume"))


def first_quote(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """The positive, non-null quote of the best (least) priority for each key."""
    ok = quotes.where(clean(F.col("value")) > 0)
    return ok.groupBy(*keys).agg(F.min_by("value", "priority").alias("value"), F.min("priority").alias("priority"))


def manifest(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument").agg(F.count("*").alias("n_bars"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def read_quotes_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(dt, close) of plain or gzipped csv files; the last positive close is then ``max_by(close, dt)``."""
    df = spark.read.option("header", True).csv(paths)
    return df.select(F.to_date("dt").alias("dt"), F.expr("try_cast(close AS double)").alias("close"))


def read_endorsed_json(spark: SparkSession, path: str) -> DataFrame | None:
    """The list under ``qualified`` of a JSON document as rows; None where the file is missing, unreadable or holds no list."""
    try:
        doc = spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return None
    if dict(doc.dtypes).get("qualified", "")[:5] != "array":
        return None
    return doc.select(F.explode("qualified").alias("q")).select("q.*")
