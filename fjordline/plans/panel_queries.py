"""Queries over bars, panels, labels, features and sessions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import pair_id, pair_name
from ..operators import calendar, features, panel, targets
from ..operators.panel import by_instrument
from ..sources import bars as B
from . import tables as T
from .registry import query

OHLC = ["open", "high", "low", "close"]


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


R6 = lambda *cs: ", ".join(f'round("{c}", 6) AS "{c}"' for c in cs)


@query("bars_daily", f'WITH {T.DAILY} SELECT instrument, dt, {R6("open", "high", "low", "close", "volume")}, round(mean_price, 6) AS mean_price FROM daily')
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return r6(T.daily(spark, sf), *OHLC, "volume").withColumn("mean_price", F.round("mean_price", 6))


@query("bars_hourly", f'WITH {T.HOURLY} SELECT instrument, hour, {R6("open", "high", "low", "close", "volume")} FROM hourly')
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return r6(T.hourly(spark, sf).drop("mean_price"), *OHLC, "volume")


NY_DAILY = """ny AS (SELECT event_type AS instrument, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS dt, first(value ORDER BY ts) AS "open", max(value) AS high, min(value) AS low,
  last(value ORDER BY ts) AS "close", CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


def ny_daily(spark: SparkSession, sf: str) -> DataFrame:
    t = T.table(spark, sf, "events").select(F.col("event_type").alias("instrument"), B.session_date("ts", calendar.ZONE).alias("dt"), "ts", "value")
    return B.to_bars(t, ["instrument", "dt"], F.col("ts"), "value", F.lit(1.0)).drop("mean_price")


@query("bars_ny_session", f'WITH {NY_DAILY} SELECT instrument, dt, {R6("open", "high", "low", "close", "volume")} FROM ny')
def bars_ny_session(spark: SparkSession, sf: str) -> DataFrame:
    return r6(ny_daily(spark, sf), *OHLC, "volume")


@query(
    "bar_upsert",
    f"""WITH {NY_DAILY}, top AS (SELECT instrument, max(dt) AS m FROM ny GROUP BY 1),
new AS (SELECT instrument, m AS dt, NULL::DOUBLE AS "open", high + 1 AS high, low, "close" + 1 AS "close", volume * 2 AS volume FROM ny JOIN top USING (instrument) WHERE dt = m
  UNION ALL SELECT instrument, m + 1, "close", "close", "close", "close", 0 FROM ny JOIN top USING (instrument) WHERE dt = m)
SELECT coalesce(n.instrument, o.instrument) AS instrument, coalesce(n.dt, o.dt) AS dt, round(coalesce(n."open", o."open"), 6) AS "open", round(coalesce(n.high, o.high), 6) AS high, round(coalesce(n.low, o.low), 6) AS low,
  round(coalesce(n."close", o."close"), 6) AS "close", round(coalesce(n.volume, o.volume), 6) AS volume FROM ny o FULL JOIN new n ON n.instrument = o.instrument AND n.dt = o.dt""",
)
def bar_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """History plus a revised last day (one field unknown) and a new flat day."""
    old = ny_daily(spark, sf)
    last = panel.last_rows(old, 1)
    revised = last.select("instrument", "dt", F.lit(None).cast("double").alias("open"), (F.col("high") + 1).alias("high"), "low", (F.col("close") + 1).alias("close"), (F.col("volume") * 2).alias("volume"))
    new = last.select("instrument", F.date_add("dt", 1).alias("dt"), *(F.col("close").alias(c) for c in OHLC), F.lit(0.0).alias("volume"))
    return r6(B.upsert_today(old, revised.unionByName(new)), *OHLC, "volume")


@query(
    "carry_forward",
    f"""WITH {NY_DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY dt DESC) AS k FROM ny)
SELECT instrument, DATE '2024-02-05' AS dt, round("close", 6) AS "open", round("close", 6) AS high, round("close", 6) AS low, round("close", 6) AS "close", 0.0::DOUBLE AS volume FROM l WHERE k = 1""",
)
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return r6(B.carry_forward(ny_daily(spark, sf), F.lit("2024-02-05").cast("date")), *OHLC, "volume")


QUOTES = """q AS (SELECT event_type AS instrument, CAST(ts AS DATE) AS dt, 1 AS priority, last(value ORDER BY ts) AS value FROM events WHERE value > 90 GROUP BY 1, 2
  UNION ALL SELECT event_type, CAST(ts AS DATE), 2, CASE WHEN max(value) > 50 THEN max(value) ELSE 0 END FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2
  UNION ALL SELECT event_type, CAST(ts AS DATE), 3, avg(value) FROM events GROUP BY 1, 2)"""


@query("quote_fallback", f"WITH {QUOTES} SELECT instrument, dt, round(arg_min(value, priority), 6) AS value, min(priority) AS priority FROM q WHERE value > 0 GROUP BY 1, 2")
def quote_fallback(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select(F.col("event_type").alias("instrument"), F.to_date("ts").alias("dt"), "ts", "value", "user_id")
    k = ["instrument", "dt"]
    one = e.where("value > 90").groupBy(*k).agg(F.max_by("value", "ts").alias("value")).withColumn("priority", F.lit(1))
    two = e.where("user_id % 3 = 0").groupBy(*k).agg(F.when(F.max("value") > 50, F.max("value")).otherwise(0.0).alias("value")).withColumn("priority", F.lit(2))
    three = e.groupBy(*k).agg(F.avg("value").alias("value")).withColumn("priority", F.lit(3))
    return r6(B.first_quote(one.unionByName(two).unionByName(three), k), "value")


@query("manifest", f"WITH {T.DAILY} SELECT instrument, count(*) AS n_bars, min(dt) AS first_dt, max(dt) AS last_dt FROM daily GROUP BY 1")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return B.manifest(T.daily(spark, sf))


@query("instrument_names", "SELECT DISTINCT c_mktsegment || '/' || o_orderpriority AS name, replace(replace(c_mktsegment || '/' || o_orderpriority, '/', '_'), ' ', '_') AS pid, replace(replace(replace(c_mktsegment || '/' || o_orderpriority, '/', '_'), ' ', '_'), '_', '/') AS back FROM customer JOIN orders ON c_custkey = o_custkey")
def instrument_names(spark: SparkSession, sf: str) -> DataFrame:
    d = T.table(spark, sf, "customer").join(T.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    d = d.select(F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("name")).distinct()
    return d.withColumn("pid", pair_id(F.col("name"))).withColumn("back", pair_name(F.col("pid")))


@query(
    "trim_period",
    f"""WITH {T.LEVEL}, t AS (SELECT *, max(dt) OVER (PARTITION BY instrument) AS m FROM level),
u AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY dt DESC) AS k FROM t WHERE dt >= m - 365)
SELECT instrument, dt, rn, round(px, 6) AS px FROM u WHERE k <= 200""",
)
def trim_period(spark: SparkSession, sf: str) -> DataFrame:
    return panel.last_rows(panel.trim_period(T.level(spark, sf), "1y"), 200).withColumn("px", F.round("px", 6))


@query(
    "end_date_last_n",
    f"""WITH {T.LEVEL}, u AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY dt DESC) AS k FROM level WHERE dt <= DATE '1998-06-30')
SELECT instrument, dt, rn, round(px, 6) AS px, max(dt) OVER (PARTITION BY instrument) AS effective_end FROM u WHERE k <= 100""",
)
def end_date_last_n(spark: SparkSession, sf: str) -> DataFrame:
    df = panel.last_rows(T.level(spark, sf), 100, F.lit("1998-06-30").cast("date"))
    return df.withColumns({"effective_end": F.max("dt").over(Window.partitionBy("instrument")), "px": F.round("px", 6)})


FUND = ["fund_sum", "fund_avg", "fund_count"]
WIDE = f"""{T.DAILY}, {T.SHARED},
wide AS (SELECT d.instrument, d.dt, d."close", d.volume, s.fund_sum, s.fund_avg, s.fund_count, lag(d."close", 60) OVER (PARTITION BY d.instrument ORDER BY d.dt) AS lag60,
  CASE WHEN extract('month' FROM d.dt) = 1 THEN d.high END AS january_high, NULL::DOUBLE AS nothing FROM daily d LEFT JOIN shared s ON s.dt = d.dt)"""
FEATURES = ["volume", *FUND, "lag60", "january_high", "nothing"]


def wide(spark: SparkSession, sf: str) -> DataFrame:
    df = T.daily(spark, sf).join(T.shared(spark, sf), "dt", "left")
    df = df.withColumns({"lag60": F.lag("close", 60).over(by_instrument()), "january_high": F.when(F.month("dt") == 1, F.col("high")), "nothing": F.lit(None).cast("double")})
    return df.select("instrument", "dt", "close", *FEATURES)


@query(
    "row_threshold",
    f"""WITH {WIDE}, n AS (SELECT *, CAST("close" IS NOT NULL AS INT) + CAST(volume IS NOT NULL AS INT) + CAST(fund_sum IS NOT NULL AS INT) + CAST(fund_avg IS NOT NULL AS INT) + CAST(fund_count IS NOT NULL AS INT)
  + CAST(lag60 IS NOT NULL AS INT) + CAST(january_high IS NOT NULL AS INT) AS k FROM wide)
SELECT instrument, count(*) AS n_rows, min(dt) AS first_dt, max(dt) AS last_dt, round(sum("close"), 2) AS close_sum FROM n WHERE "close" IS NOT NULL AND k >= 5 GROUP BY 1""",
)
def row_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Null closes and empty columns go first, then rows with too few values."""
    df = wide(spark, sf).na.drop(subset=["close"])
    shares = df.agg(*(F.count(c).alias(c) for c in FEATURES)).first()
    columns = ["close", *(c for c in FEATURES if shares[c])]
    out = panel.drop_sparse_rows(df, columns)
    return out.groupBy("instrument").agg(F.count("*").alias("n_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.round(F.sum("close"), 2).alias("close_sum"))


@query("col_share", f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT instrument, '{c}' AS feature, round(count({c}) / count(*), 6) AS share FROM wide GROUP BY 1" for c in FEATURES))
def col_share(spark: SparkSession, sf: str) -> DataFrame:
    return r6(panel.non_null_shares(wide(spark, sf), FEATURES, ["instrument"]), "share")


@query(
    "usable_rows",
    f"""WITH {WIDE}, y AS (SELECT *, lead("close", 2) OVER (PARTITION BY instrument ORDER BY dt) / "close" - 1 AS forward_r FROM wide)
SELECT instrument, count(*) AS n_rows, CASE WHEN count(*) < 80 THEN 'too_few_rows' ELSE 'ok' END AS status FROM y WHERE forward_r IS NOT NULL AND forward_r <> 0 AND (lag60 IS NOT NULL OR fund_sum IS NOT NULL) GROUP BY 1""",
)
def usable_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = wide(spark, sf).withColumn("forward_r", targets.forward_return(2)).withColumn("y", targets.binary_label(F.col("forward_r")))
    return panel.row_guard(panel.usable_rows(df, ["lag60", "fund_sum"]))


CANDIDATES = ("fund_", "lag", "january", "nothing", "volume")


@query(
    "panel_prepared",
    f"""WITH {WIDE}, ny AS (SELECT (((max(dt) - 3)::TIMESTAMP + INTERVAL 22 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM daily),
s AS (SELECT CASE WHEN extract('isodow' FROM t) <= 5 AND extract('hour' FROM t) >= 17 THEN CAST(t AS DATE) ELSE CAST(t AS DATE) - CASE extract('isodow' FROM t) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END::INTEGER END AS through FROM ny)
SELECT instrument, dt, round(volume, 6) AS volume, round(fund_sum, 2) AS fund_sum, fund_count, round(lag60, 6) AS lag60 FROM wide, s
WHERE dt <= through AND (volume IS NOT NULL)::INT + (fund_sum IS NOT NULL)::INT + (fund_count IS NOT NULL)::INT + (lag60 IS NOT NULL)::INT >= 4""",
)
def panel_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """From candidate columns to a panel: chosen by prefix and suffix, empty and thinly filled ones dropped, rows up to the last complete session with enough values."""
    df = wide(spark, sf)
    day = df.agg(F.max("dt").alias("d")).first()["d"]
    df = panel.until_session(df, F.lit(datetime.datetime.combine(day - datetime.timedelta(days=3), datetime.time(22))))
    names = panel.columns_like(df, CANDIDATES, ("_avg",))
    df = panel.drop_empty_columns(df, names)
    kept = panel.kept_columns(df, [c for c in names if c in df.columns])
    out = panel.drop_sparse_rows(df, kept, least=4).select("instrument", "dt", *sorted(kept))
    return r6(out, *(c for c in ("volume", "lag60") if c in kept)).withColumn("fund_sum", F.round("fund_sum", 2))


FILL = lambda c, frame: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN {frame} AND CURRENT ROW)"


@query(
    "exact_ffill_join",
    f"""WITH {T.DAILY}, {T.SHARED}, j AS (SELECT instrument, d.dt, "close", fund_sum, fund_count FROM daily d LEFT JOIN shared s ON s.dt = d.dt AND extract('isodow' FROM s.dt) <= 5)
SELECT instrument, dt, round("close", 6) AS "close", round({FILL("fund_sum", "UNBOUNDED PRECEDING")}, 2) AS fund_sum, {FILL("fund_count", "UNBOUNDED PRECEDING")} AS fund_count FROM j""",
)
def exact_ffill_join(spark: SparkSession, sf: str) -> DataFrame:
    s = T.shared(spark, sf).where(F.weekday("dt") < 5)
    df = panel.join_exact_filled(T.daily(spark, sf).select("instrument", "dt", "close"), s, ["fund_sum", "fund_count"], ["dt"])
    return df.select("instrument", "dt", F.round("close", 6).alias("close"), F.round("fund_sum", 2).alias("fund_sum"), "fund_count")


@query(
    "asof_option",
    f"""WITH {T.DAILY}, {T.SHARED}, s AS (SELECT * FROM shared WHERE extract('isodow' FROM dt) = 6)
SELECT d.instrument, d.dt, round(s.fund_sum, 2) AS fund_sum FROM daily d ASOF LEFT JOIN s ON d.dt >= s.dt""",
)
def asof_option(spark: SparkSession, sf: str) -> DataFrame:
    """Values dated on Saturdays are carried to the next bars."""
    s = T.shared(spark, sf).where(F.weekday("dt") == 5)
    return panel.join_as_of(T.daily(spark, sf).select("instrument", "dt"), s, ["fund_sum"]).withColumn("fund_sum", F.round("fund_sum", 2))


@query(
    "context_ffill5",
    f"""WITH {T.DAILY}, a AS (SELECT dt, "close" AS ctx FROM daily WHERE instrument = 'A' AND extract('day' FROM dt) > 8), j AS (SELECT d.instrument, d.dt, ctx FROM daily d LEFT JOIN a ON a.dt = d.dt WHERE d.instrument <> 'A')
SELECT instrument, dt, round({FILL("ctx", "5 PRECEDING")}, 6) AS ctx FROM j""",
)
def context_ffill5(spark: SparkSession, sf: str) -> DataFrame:
    d = T.daily(spark, sf).select("instrument", "dt", "close")
    ctx = d.where("instrument = 'A' AND day(dt) > 8").select("dt", F.col("close").alias("ctx"))
    return r6(panel.join_exact_filled(d.where("instrument <> 'A'"), ctx, ["ctx"], ["dt"], limit=5).select("instrument", "dt", "ctx"), "ctx")


LEADS = range(1, 11)


@query("fwd_return_all_leads", f"WITH {T.LEVEL} SELECT instrument, dt, " + ", ".join(f"round(lead(px, {k}) OVER (PARTITION BY instrument ORDER BY dt) / px - 1, 6) AS r{k}" for k in LEADS) + " FROM level")
def fwd_return_all_leads(spark: SparkSession, sf: str) -> DataFrame:
    df = targets.forward_returns(T.level(spark, sf), LEADS, "px")
    return r6(df.select("instrument", "dt", *(f"r{k}" for k in LEADS)), *(f"r{k}" for k in LEADS))


FWD5 = f"{T.LEVEL}, f AS (SELECT *, lead(px, 5) OVER (PARTITION BY instrument ORDER BY dt) / px - 1 AS r FROM level)"


@query("labels_binary", f"WITH {FWD5} SELECT instrument, dt, CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN 0 END AS y FROM f")
def labels_binary(spark: SparkSession, sf: str) -> DataFrame:
    return T.level(spark, sf).withColumn("r", targets.forward_return(5, "px")).select("instrument", "dt", targets.binary_label(F.col("r")).alias("y"))


@query("labels_ternary", f"WITH {FWD5} SELECT instrument, dt, CASE WHEN r < -0.005 THEN 0 WHEN r <= 0.005 THEN 1 WHEN r > 0.005 THEN 2 END AS y FROM f")
def labels_ternary(spark: SparkSession, sf: str) -> DataFrame:
    return T.level(spark, sf).withColumn("r", targets.forward_return(5, "px")).select("instrument", "dt", targets.ternary_label(F.col("r")).alias("y"))


EXC = f"""{T.LEVEL}, j AS (SELECT l.instrument, l.dt, d.high, d.low, d."close" FROM level l JOIN daily d USING (instrument, dt)),
exc AS (SELECT instrument, dt, CASE WHEN count(high) OVER w = 5 AND count(low) OVER w = 5 THEN max(high) OVER w / "close" - 1 END AS hi_exc,
  CASE WHEN count(high) OVER w = 5 AND count(low) OVER w = 5 THEN min(low) OVER w / "close" - 1 END AS lo_exc,
  CASE WHEN count(high) OVER w = 5 AND count(low) OVER w = 5 THEN lead("close", 5) OVER (PARTITION BY instrument ORDER BY dt) / "close" - 1 END AS close_ret
  FROM j WINDOW w AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""


def exc(spark: SparkSession, sf: str) -> DataFrame:
    d = T.daily(spark, sf).select("instrument", "dt", "high", "low", "close")
    return targets.excursions(T.level(spark, sf).select("instrument", "dt").join(d, ["instrument", "dt"]), 5)


@query("excursions", f"WITH {EXC} SELECT instrument, dt, round(hi_exc, 6) AS hi_exc, round(lo_exc, 6) AS lo_exc, round(close_ret, 6) AS close_ret FROM exc")
def excursions(spark: SparkSession, sf: str) -> DataFrame:
    c = ("hi_exc", "lo_exc", "close_ret")
    return r6(exc(spark, sf).select("instrument", "dt", *c), *c)


@query(
    "labels_path_binary",
    f"""WITH {EXC} SELECT instrument, dt, CASE WHEN hi_exc >= abs(lo_exc) AND hi_exc > 0 THEN 1 WHEN abs(lo_exc) > hi_exc AND lo_exc < 0 THEN 0 WHEN close_ret > 0 THEN 1 WHEN close_ret < 0 THEN 0 END AS y FROM exc""",
)
def labels_path_binary(spark: SparkSession, sf: str) -> DataFrame:
    return exc(spark, sf).select("instrument", "dt", targets.path_binary(F.col("hi_exc"), F.col("lo_exc"), F.col("close_ret")).alias("y"))


@query(
    "labels_path_ternary",
    f"""WITH {EXC} SELECT instrument, dt, CASE WHEN hi_exc IS NULL THEN NULL WHEN hi_exc > 0.005 AND lo_exc < -0.005 THEN CASE WHEN hi_exc >= abs(lo_exc) THEN 2 ELSE 0 END
WHEN hi_exc > 0.005 THEN 2 WHEN lo_exc < -0.005 THEN 0 ELSE 1 END AS y FROM exc""",
)
def labels_path_ternary(spark: SparkSession, sf: str) -> DataFrame:
    return exc(spark, sf).select("instrument", "dt", targets.path_ternary(F.col("hi_exc"), F.col("lo_exc")).alias("y"))


RET = f"{T.LEVEL}, ret AS (SELECT *, (px / lag(px) OVER (PARTITION BY instrument ORDER BY dt) - 1) * 100 AS ret FROM level)"


@query(
    "realized_vol",
    f"""WITH {RET} SELECT instrument, dt, round(CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w END, 6) AS vol FROM ret
WINDOW w AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def realized_vol(spark: SparkSession, sf: str) -> DataFrame:
    df = features.realized_vol(features.pct_change(T.level(spark, sf), "px"))
    return r6(df.select("instrument", "dt", "vol"), "vol")


@query(
    "ewma_vol",
    f"""WITH RECURSIVE {RET}, r AS (SELECT instrument, dt, ret, row_number() OVER (PARTITION BY instrument ORDER BY dt) AS i FROM ret WHERE ret IS NOT NULL),
e AS (SELECT instrument, dt, i, ret * ret AS v FROM r WHERE i = 1
  UNION ALL SELECT r.instrument, r.dt, r.i, e.v * pow(2::DOUBLE, -1::DOUBLE / 60) + (1 - pow(2::DOUBLE, -1::DOUBLE / 60)) * r.ret * r.ret FROM e JOIN r ON r.instrument = e.instrument AND r.i = e.i + 1)
SELECT instrument, dt, round(sqrt(v), 6) AS vol FROM e""",
)
def ewma_vol(spark: SparkSession, sf: str) -> DataFrame:
    return r6(features.ewma_vol(features.pct_change(T.level(spark, sf), "px")), "vol")


@query(
    "sequences",
    f"""WITH {RET}, s AS (SELECT instrument, dt, rn, list(ret) OVER w AS a, count(*) OVER w AS c, sum(ret) OVER w AS total FROM ret WHERE ret IS NOT NULL
WINDOW w AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT instrument, dt, CAST(c AS INTEGER) AS seq_len, round(a[1], 6) AS first_ret, round(a[8], 6) AS last_ret FROM s WHERE c = 8""",
)
def sequences(spark: SparkSession, sf: str) -> DataFrame:
    df = features.sequences(features.pct_change(T.level(spark, sf), "px").where("ret IS NOT NULL"), ["ret"], 8)
    return df.select("instrument", "dt", F.size("seq").alias("seq_len"), F.round(F.expr("seq[0][0]"), 6).alias("first_ret"), F.round(F.expr("seq[7][0]"), 6).alias("last_ret"))


NEXT_BD = lambda d: f"({d} + CASE WHEN extract('isodow' FROM {d}) = 5 THEN 3 WHEN extract('isodow' FROM {d}) = 6 THEN 2 ELSE 1 END::INTEGER)"


@query(
    "session_dates",
    f"""WITH n AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM events),
d AS (SELECT event_id, CAST(ny AS DATE) AS day, extract('isodow' FROM ny) <= 5 AND extract('hour' FROM ny) >= 17 AS rolled FROM n),
t AS (SELECT event_id, CASE WHEN rolled THEN day ELSE day - CASE WHEN extract('isodow' FROM day) = 1 THEN 3 WHEN extract('isodow' FROM day) = 7 THEN 2 ELSE 1 END::INTEGER END AS through FROM d)
SELECT event_id, through AS data_through, {NEXT_BD("through")} AS target, {NEXT_BD(NEXT_BD(NEXT_BD("through")))} AS lead3 FROM t""",
)
def session_dates(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select("event_id", calendar.new_york(F.col("ts")).alias("ny"))
    through, target = calendar.session_dates(F.col("ny"))
    df = e.select("event_id", through.alias("data_through"), target.alias("target"))
    return df.withColumn("lead3", calendar.forecast_date(F.col("data_through"), 3))


@query("garch_vol")
def garch_vol(spark: SparkSession, sf: str) -> DataFrame:
    return r6(features.garch_vol(features.pct_change(T.level(spark, sf), "px")), "sigma")


@query("garch_columns")
def garch_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Levels with their realised volatility and the held GARCH forecast beside them."""
    names = ("feat_garch_realized_vol20_pct", "feat_garch_cond_sigma_pct")
    return r6(features.with_garch(T.level(spark, sf), "px").select("instrument", "dt", *names), *names)
