"""Bars from a stream: watermarked tumbling windows whose updates are kept by batch, read back as the latest state."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from .. import ship
from ..operators.calendar import ZONE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tumbling_bars(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """One updating bar an (instrument, window); rows later than ``late`` behind the newest are dropped by the watermark."""
    e = events.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    return e.groupBy("instrument", F.window("ts", width).alias("w")).agg(
        F.min_by("value", F.struct("ts", "value")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "value")).alias("close"), F.count("*").cast("double").alias("volume")
    ).select("instrument", F.col("w.start").cast("timestamp_ntz").alias("hour"), "open", "high", "low", "close", "volume")


PARTIAL = "instrument string, dt date, first timestamp, ts timestamp, open double, high double, low double, close double, volume double"
SESSION = "instrument string, dt date, open double, high double, low double, close double, volume double, closed boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def partial_bars(events: DataFrame, roll_hour: int = 24) -> DataFrame:
    """Ticks summed to a partial bar for each instrument and session in every batch of rows, so that a busy instrument's ticks don't travel one by one. A session is the New York day that
    ends at ``roll_hour``: later ticks belong to the next."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f.instrument.notna() & f.ts.notna() & f.value.notna()].sort_values("ts", kind="stable")
            if len(f):
                f = f.assign(volume=1.0, first=f.ts, open=f.value, high=f.value, low=f.value, close=f.value)
                made = f.groupby(["instrument", "dt"], as_index=False).agg({"first": "first", "ts": "last", "open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"})
                yield made[[c.split()[0] for c in PARTIAL.split(", ")]]

    ship(events.sparkSession)
    ny = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.col("ts").cast("timestamp_ntz"))
    ticks = events.select(F.col("event_type").alias("instrument"), F.to_date(ny + F.make_interval(hours=F.lit(24 - roll_hour))).alias("dt"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return ticks.mapInPandas(work, PARTIAL)


class SessionBars(StatefulProcessor):
    """One open bar an (instrument, session): partial bars are merged and the changed bar is given out; an event-time timer at the session's end closes it."""

    def __init__(self, roll_hour: int):
        self.roll_hour = roll_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", "first timestamp, ts timestamp, open double, high double, low double, close double, volume double")

    def _out(self, key, bar, closed: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, *bar[2:], closed)], columns=[c.split()[0] for c in SESSION.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [tuple(r) for f in rows for r in f[["first", "ts", "open", "high", "low", "close", "volume"]].itertuples(index=False)]
        if self.bar.exists():
            old = self.bar.get()
            parts.append((pd.Timestamp(old[0]), pd.Timestamp(old[1]), *old[2:]))
        else:
            end = datetime.datetime.combine(key[1], datetime.time()).replace(tzinfo=ZoneInfo(ZONE)) + datetime.timedelta(hours=self.roll_hour)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        opens, closes = min(parts, key=lambda p: (p[0], p[2])), max(parts, key=lambda p: (p[1], p[5]))
        bar = (opens[0].to_pydatetime(), closes[1].to_pydatetime(), float(opens[2]), float(max(p[3] for p in parts)), float(min(p[4] for p in parts)), float(closes[5]), float(sum(p[6] for p in parts)))
        self.bar.update(bar)
        yield self._out(key, bar, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bar.exists():
            yield self._out(key, tuple(self.bar.get()), True)
            self.bar.clear()

    def close(self) -> None:
        pass


def session_bars(events: DataFrame, late: str = "2 days", roll_hour: int = 24) -> DataFrame:
    """A stream of bars by New York session, each again whenever it changes, and once more as ``closed`` when the watermark (``late`` behind the newest tick) passes the session's end. Ticks behind the watermark of the batch before are dropped."""
    parts = partial_bars(events, roll_hour).withWatermark("ts", late)
    return parts.groupBy("instrument", "dt").transformWithStateInPandas(SessionBars(roll_hour), SESSION, "Update", "EventTime")


def stream_session_bars(spark: SparkSession, path: str, roll_hour: int = 24) -> DataFrame:
    """The latest state of every session's bar after all of ``path`` has been streamed."""
    folder, before = shared_folder(spark, "sessions"), spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        run_to_table(session_bars(spark.readStream.schema(EVENTS).parquet(path), roll_hour=roll_hour), folder)
    finally:
        spark.conf.set(STORE, before)
    return latest_bars(spark, folder, ("instrument", "dt"), ("closed",))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_table(bars: DataFrame, folder: str, mode: str = "update") -> None:
    """Process all that is available; every micro-batch writes its changed bars under its own number, so a repeated batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/bars/batch={number}")

    bars.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def latest_bars(spark: SparkSession, folder: str, keys: tuple[str, ...] = ("instrument", "hour"), last: tuple[str, ...] = ()) -> DataFrame:
    """Each bar's row of the latest batch; among several of one batch the one with the largest ``last``."""
    df = spark.read.parquet(f"{folder}/bars")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"), *(F.desc(c) for c in last))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "batch")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, one of this machine, which only a local session can use."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fjordline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_hourly_bars(spark: SparkSession, path: str) -> DataFrame:
    """``path`` is a folder or pattern of event files."""
    folder = shared_folder(spark, "stream")
    run_to_table(tumbling_bars(spark.readStream.schema(EVENTS).parquet(path)), folder)
    return latest_bars(spark, folder)
