"""Recorded quote responses as a data source, in batch and as a stream.

A recording is a folder with one folder a day (``day=2024-01-05``) of JSON lines, each a response: instrument, granularity and its points (time, value). Days are partitions and the offsets
of a stream. Options choose the days and the granularities, so other days' folders aren't opened and other responses' points not read: filters are no part of it, since Spark 4.1 keeps what
was pushed into a Python source for all later queries on the same DataFrame. ``priority`` numbers the granularities in the order of preference, so ``bars.first_quote`` picks the
finest that has a usable value.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import ship

FORMAT, SCHEMA = "recorded_quotes", "instrument string, dt date, granularity string, priority int, time timestamp_ntz, value double"
GRANULARITIES = "tick,block,mean"

class Day(InputPartition):
    def __init__(self, day: str):
        super().__init__(day)
        self.day = day


class _Recording:
    """The days of a recording and the rows of one."""

    def __init__(self, options: dict):
        self.path, self.names = options["path"], options.get("granularities", GRANULARITIES).split(",")
        self.since, self.until = options.get("since", ""), options.get("until", "9999-12-31")

    def days(self) -> list[str]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        days = (f.base_name.removeprefix("day=") for f in found if f.base_name.startswith("day="))
        return sorted(d for d in days if self.since <= d <= self.until)

    def rows(self, day: str) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        dt, columns = datetime.date.fromisoformat(day), ([], [], [], [])
        types = [pa.string(), pa.date32(), pa.string(), pa.int32(), pa.timestamp("us"), pa.float64()]

        def batch() -> pa.RecordBatch:
            who, what, when, value = columns
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((who, [dt] * len(who), what, [self.names.index(g) + 1 for g in what], when, value), types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for info in store.get_file_info(fs.FileSelector(f"{root}/day={day}")):
            if not info.base_name.endswith(".json"):
                continue
            with store.open_input_stream(info.path) as raw:
                for line in _lines(raw):
                    r = json.loads(line)
                    if r.get("granularity") not in self.names:
                        continue
                    for p in r.get("points") or ():
                        for c, v in zip(columns, (r.get("instrument"), r["granularity"], datetime.datetime.fromisoformat(p["t"]), p.get("v")), strict=True):
                            c.append(v)
                    if len(columns[0]) >= 10_000:
                        yield batch()
                        columns = ([], [], [], [])
        if columns[0]:
            yield batch()


def _lines(raw) -> Iterator[bytes]:
    held = b""
    while chunk := raw.read(1 << 20):
        *whole, held = (held + chunk).split(b"\n")
        yield from (x for x in whole if x.strip())
    if held.strip():
        yield held


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.recording = _Recording(options)

    def partitions(self) -> list[Day]:
        return [Day(d) for d in self.recording.days()]

    def read(self, partition: Day | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks once with none where there are no days
            yield from self.recording.rows(partition.day)


class QuoteStream(DataSourceStreamReader):
    """Offsets are days: a batch holds the days after the last one up to the newest that is recorded. A day is taken to be complete once it is there."""

    def __init__(self, options: dict):
        self.recording = _Recording(options)

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        return {"day": max(self.recording.days(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return [Day(d) for d in self.recording.days() if start["day"] < d <= end["day"]]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        yield from self.recording.rows(partition.day)


class RecordedQuotes(DataSource):
    """Options: ``path``, ``granularities`` (best first, separated by commas), ``since`` and ``until`` (days, both included)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(dict(self.options))

    def streamReader(self, schema) -> QuoteStream:
        return QuoteStream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RecordedQuotes)


def record(responses: DataFrame, folder: str) -> None:
    """Write responses (instrument, granularity, day, points: array of (t, v)) as a recording."""
    responses.write.mode("append").partitionBy("day").json(folder)


def read_quotes(spark: SparkSession, folder: str, granularities: str = GRANULARITIES, since: str = "", until: str = "9999-12-31") -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(granularities=granularities, since=since, until=until).load(folder)


def stream_quotes(spark: SparkSession, folder: str, granularities: str = GRANULARITIES) -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).option("granularities", granularities).load(folder)


def last_of_each(quotes: DataFrame) -> DataFrame:
    """(instrument, dt, priority, value): the latest point of each granularity."""
    return quotes.groupBy("instrument", "dt", "priority").agg(F.max_by("value", F.struct("time", "value")).alias("value"))
