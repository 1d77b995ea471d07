from pyspark.sql import functions as F

from fjordline.operators import select
from fjordline.sources import sinks
from fjordline.streaming import bars as stream


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "run string, acc double")
    sinks.write_tables({"one": df, "two": df}, str(tmp_path))
    assert sinks.read_tables(spark, str(tmp_path), ["one", "two"])["two"].collect() == df.collect()


def test_sweep_resumes(spark, tmp_path):
    plan = spark.createDataFrame([("a",), ("b",)], "run string")
    sinks.append_runs(plan.where("run = 'a'"), str(tmp_path / "sweep"))
    assert [r.run for r in select.unfinished(plan, spark.read.parquet(str(tmp_path / "sweep"))).collect()] == ["b"]


def test_text_forms(spark):
    df = spark.createDataFrame([("“a” – 漢", 1.23456, None)], "s string, x double, y double")
    assert df.select(sinks.ascii_text(F.col("s"))).first()[0] == '"a" - ?'
    assert sinks.markdown_rows(df.select("x", "y"), ["x", "y"]).first().line == "| 1.235 | NA |"
    df = spark.createDataFrame([(1, "a" * 50, 2.5, None)], "x int, long string, z double, n int")
    assert df.select(sinks.extra_json(["x", "long", "z", "n"], 30)).first()[0] == '{"x":1,"z":2.5}'
    assert df.select(sinks.extra_json(["x", "long", "n"])).first()[0] == '{"x":1,"long":"%s"}' % ("a" * 50)
    assert df.select(sinks.extra_json(["n"], 5)).first()[0] == "{}"


def test_endorsement_document(spark, tmp_path):
    rows = spark.createDataFrame([("r", "binary", 0.7)], "run string, target_mode string, acc double")
    sinks.write_endorsed(rows, str(tmp_path), {"made": "today"})
    doc = spark.read.json(str(tmp_path / "json")).first()
    assert doc.made == "today" and doc.qualified[0].acc == 0.7
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["acc"]


def test_late_rows_change_their_bar(spark, tmp_path):
    """Two files arrive one after the other; the second changes an hour of the first."""
    schema, folder = stream.EVENTS, str(tmp_path / "in")
    rows = lambda *x: spark.createDataFrame([(i, t, 1, "a", v, "") for i, t, v in x], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp_ntz("ts"))
    out = str(tmp_path / "out")
    for part in (((1, "2024-01-01 10:05:00", 1.0), (2, "2024-01-01 10:50:00", 2.0)), ((3, "2024-01-01 10:01:00", 9.0), (4, "2024-01-01 11:00:00", 4.0))):
        rows(*part).coalesce(1).write.mode("append").parquet(folder)
        stream.run_to_table(stream.tumbling_bars(spark.readStream.schema(schema).parquet(folder)), out)
    got = {str(r.hour)[11:13]: (r.open, r.high, r.low, r.close, r.volume) for r in stream.latest_bars(spark, out).collect()}
    assert got == {"10": (9.0, 9.0, 1.0, 2.0, 3.0), "11": (4.0, 4.0, 4.0, 4.0, 1.0)}


def test_sessions_close_after_a_gap(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 11:30:00")], "user_id long, ts string")
    df = rows.select("user_id", F.to_timestamp_ntz("ts").alias("ts"), F.lit(1.0).alias("value"))
    assert sorted(r.n for r in stream.session_counts(df).collect()) == [1, 2]
