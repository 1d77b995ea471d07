"""Streaming queries, checked against the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bars as B, quotes
from ..streaming import bars
from . import tables as T
from .panel_queries import NY_DAILY, OHLC, QUOTES, R6, r6
from .registry import query


@query("stream_bars_hourly", f'WITH {T.HOURLY} SELECT instrument, hour, {R6("open", "high", "low", "close", "volume")} FROM hourly')
def stream_bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return r6(bars.stream_hourly_bars(spark, f"{sf}/event[s].parquet"), *OHLC, "volume")


@query("stream_bars_session", f'WITH {NY_DAILY} SELECT instrument, dt, {R6("open", "high", "low", "close", "volume")} FROM ny')
def stream_bars_session(spark: SparkSession, sf: str) -> DataFrame:
    """Bars kept in state and closed by timers equal the batch bars of New York days."""
    return r6(bars.stream_session_bars(spark, f"{sf}/event[s].parquet").drop("closed"), *OHLC, "volume")


def recorded(spark: SparkSession, sf: str) -> str:
    """The events as a recording: ticks above 90 by the hour, each day's highest value of every third user, each day's mean."""
    folder = bars.shared_folder(spark, "quotes")
    e = T.table(spark, sf, "events").select(F.col("event_type").alias("instrument"), F.to_date("ts").alias("day"), "ts", "value", "user_id")
    point = lambda t, v: F.struct(t.cast("string").alias("t"), v.alias("v"))
    midnight = F.min(F.date_trunc("day", "ts")).cast("timestamp_ntz")
    ticks = e.where("value > 90").groupBy("instrument", "day", F.hour("ts").alias("h")).agg(F.collect_list(point(F.col("ts"), F.col("value"))).alias("points"))
    day = e.groupBy("instrument", "day")
    block = e.where("user_id % 3 = 0").groupBy("instrument", "day").agg(F.array(point(midnight, F.when(F.max("value") > 50, F.max("value")).otherwise(0.0))).alias("points"))
    mean = day.agg(F.array(point(midnight, F.avg("value"))).alias("points"))
    named = [df.select("instrument", "day", F.lit(g).alias("granularity"), "points") for g, df in (("tick", ticks), ("block", block), ("mean", mean))]
    quotes.record(named[0].union(named[1]).union(named[2]), folder)
    return folder


FALLBACK = f"WITH {QUOTES} SELECT instrument, dt, round(arg_min(value, priority), 6) AS value, min(priority) AS priority FROM q WHERE value > 0 GROUP BY 1, 2"


@query("quotes_recorded", FALLBACK)
def quotes_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """The best quote of each day, from recorded responses in the order of their granularities."""
    return r6(B.first_quote(quotes.last_of_each(quotes.read_quotes(spark, recorded(spark, sf))), ["instrument", "dt"]), "value")


@query("quotes_streamed", FALLBACK)
def quotes_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream over the recording, whose batches are kept under their numbers."""
    folder = bars.shared_folder(spark, "quotes-stream")
    bars.run_to_table(quotes.stream_quotes(spark, recorded(spark, sf)), folder, "append")
    return r6(B.first_quote(quotes.last_of_each(spark.read.parquet(f"{folder}/bars")), ["instrument", "dt"]), "value")
