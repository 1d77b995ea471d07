"""Session bars kept in state: timers, late ticks, restarts."""

import datetime

from pyspark.sql import functions as F

from fjordline.sources import bars as B
from fjordline.sources import quotes
from fjordline.streaming import bars

T0 = datetime.datetime(2024, 3, 8, 14, 0)  # a Friday, 9:00 in New York; clocks change on the 10th


def events(spark, rows):
    data = [(i, T0 + datetime.timedelta(hours=h), 1, k, v, "") for i, (h, k, v) in enumerate(rows)]
    return spark.createDataFrame(data, bars.EVENTS)


def run(spark, folder, path, **options):
    spark.conf.set(bars.STORE, bars.ROCKS)
    stream = bars.session_bars(spark.readStream.schema(bars.EVENTS).option("maxFilesPerTrigger", 1).parquet(path), **options)
    bars.run_to_table(stream, folder)
    return {(r.instrument, str(r.dt)): tuple(r)[2:] for r in bars.latest_bars(spark, folder, ("instrument", "dt"), ("closed",)).collect()}


def test_sessions_close_by_timer_and_take_late_ticks(spark, tmp_path):
    path, folder = f"{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda rows: events(spark, rows).coalesce(1).write.mode("append").parquet(path)
    put([(0, "a", 5.0), (2, "a", 7.0), (1, "a", 3.0), (9, "b", 1.0), (16, "a", 4.0)])  # 16 hours on it is Saturday in New York
    got = run(spark, folder, path)
    assert got["a", "2024-03-08"] == (5.0, 7.0, 3.0, 7.0, 3.0, False) and got["a", "2024-03-09"] == (4.0, 4.0, 4.0, 4.0, 1.0, False)
    put([(1.5, "a", 9.0), (2.5, "a", 6.0)])  # late, but the watermark is two days behind
    got = run(spark, folder, path)  # goes on from its checkpoint
    assert got["a", "2024-03-08"] == (5.0, 9.0, 3.0, 6.0, 5.0, False)
    for rows in ([(100, "a", 2.0)], [(101, "a", 2.5)], [(101.5, "a", 2.5), (3, "a", 99.0)]):  # the last tick is behind the watermark of the batch before
        put(rows)
        got = run(spark, folder, path)
    assert got["a", "2024-03-08"] == (5.0, 9.0, 3.0, 6.0, 5.0, True) and got["b", "2024-03-08"] == (1.0, 1.0, 1.0, 1.0, 1.0, True)
    assert got["a", "2024-03-12"][:5] == (2.0, 2.5, 2.0, 2.5, 3.0) and not got["a", "2024-03-12"][5]


def test_sessions_may_roll_at_five(spark, tmp_path):
    path = f"{tmp_path}/in"
    events(spark, [(7.9, "a", 1.0), (8.0, "a", 2.0), (80.0, "a", 3.0)]).coalesce(1).write.parquet(path)  # 16:54 and 17:00 on Friday, 18:00 (summer time) on Monday
    got = run(spark, f"file://{tmp_path}/out", path, roll_hour=17)
    assert {k[1]: v[0] for k, v in got.items()} == {"2024-03-08": 1.0, "2024-03-09": 2.0, "2024-03-12": 3.0}


def test_partial_bars_skip_what_is_missing(spark):
    df = events(spark, [(0, "a", 1.0), (0, None, 1.0), (1, "a", None), (2, "a", 4.0)])
    got = bars.partial_bars(df.coalesce(1)).collect()
    assert [(r.instrument, r.open, r.high, r.close, r.volume) for r in got] == [("a", 1.0, 4.0, 4.0, 2.0)]
    assert bars.partial_bars(df.where(F.lit(False))).count() == 0


def responses(spark):
    rows = [("a", "tick", "2024-01-05", [("2024-01-05 10:00:00.5", 1.0), ("2024-01-05 11:00:00", 2.0)]), ("a", "mean", "2024-01-05", [("2024-01-05 00:00:00", 9.0)]), ("b", "other", "2024-01-05", [("2024-01-05 00:00:00", 7.0)]), ("b", "block", "2024-01-06", [("2024-01-06 00:00:00", 0.0)]), ("b", "mean", "2024-01-06", [("2024-01-06 00:00:00", 4.0)]), ("c", "tick", "2024-01-07", [])]
    return spark.createDataFrame([(*r[:2], datetime.date.fromisoformat(r[2]), r[3]) for r in rows], "instrument string, granularity string, day date, points array<struct<t:string,v:double>>")


def test_recorded_quotes_fall_back_and_skip(spark, tmp_path):
    folder = f"file://{tmp_path}/quotes"
    quotes.record(responses(spark), folder)
    df = quotes.read_quotes(spark, folder)
    assert df.count() == 5 and {r.instrument for r in df.where("granularity = 'tick'").collect()} == {"a"}
    best = {(r.instrument, str(r.dt)): (r.value, r.priority) for r in B.first_quote(quotes.last_of_each(df), ["instrument", "dt"]).collect()}
    assert best == {("a", "2024-01-05"): (2.0, 1), ("b", "2024-01-06"): (4.0, 3)}
    assert quotes.last_of_each(quotes.read_quotes(spark, folder, "mean,tick")).where("instrument = 'a' AND priority = 1").first().value == 9.0
    part = quotes.read_quotes(spark, folder, "block,mean", since="2024-01-06")
    assert part.count() == 2 and part.where("granularity = 'mean'").count() == 1 and part.count() == 2
    assert [p.day for p in quotes.QuoteReader({"path": folder, "until": "2024-01-06"}).partitions()] == ["2024-01-05", "2024-01-06"]
    assert quotes.read_quotes(spark, f"file://{tmp_path}/none").count() == 0


def test_recorded_quotes_stream_by_days(spark, tmp_path):
    folder, out = f"file://{tmp_path}/quotes", f"file://{tmp_path}/out"
    go = lambda: (bars.run_to_table(quotes.stream_quotes(spark, folder), out, "append"), spark.read.parquet(f"{out}/bars").count())[1]
    quotes.record(responses(spark).where("day < DATE'2024-01-06'"), folder)
    assert go() == 3
    quotes.record(responses(spark).where("day >= DATE'2024-01-06'"), folder)
    assert go() == 5 == go()
