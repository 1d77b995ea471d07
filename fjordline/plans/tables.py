"""The analytics tables built from the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..functions.exprs import ratio, sign
from ..operators import backtest, folds
from ..operators.panel import by_instrument
from ..sources import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("dt"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return B.to_bars(t, ["instrument", "dt"], order, "l_extendedprice", F.col("l_quantity"))


DAILY = """daily AS (SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS dt,
  first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS "open", max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS "close",
  sum(l_quantity) AS volume, avg(l_extendedprice) AS mean_price FROM lineitem GROUP BY 1, 2)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "value")
    return B.to_bars(t, ["instrument", "hour"], F.col("ts"), "value", F.lit(1.0))


HOURLY = """hourly AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS hour, first(value ORDER BY ts) AS "open", max(value) AS high, min(value) AS low,
  last(value ORDER BY ts) AS "close", CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse daily features common to all instruments."""
    t = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt"))
    return t.agg(F.sum("o_totalprice").alias("fund_sum"), F.avg("o_totalprice").alias("fund_avg"), F.count("*").cast("double").alias("fund_count"))


SHARED = """shared AS (SELECT CAST(o_orderdate AS DATE) AS dt, sum(o_totalprice) AS fund_sum, avg(o_totalprice) AS fund_avg, CAST(count(*) AS DOUBLE) AS fund_count
  FROM orders GROUP BY 1)"""


def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.smoothed_level(daily(spark, sf_dir))


LEVEL = (
    DAILY
    + """,
level AS (SELECT instrument, dt, k - 21 AS rn, px FROM (SELECT instrument, dt,
  avg(mean_price) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS px,
  row_number() OVER (PARTITION BY instrument ORDER BY dt) AS k FROM daily) WHERE k > 20)"""
)

SPANS = (1, 3, 5)


def signals(spark: SparkSession, sf_dir: str, lead: int = 1) -> DataFrame:
    """Rule probabilities: p1 = 0.5 + 0.5 * mean sign of the last k moves, one model a k; labels from the forward return."""
    w = by_instrument()
    df = level(spark, sf_dir).withColumn("move", sign(F.round(ratio(F.col("px"), F.lag("px").over(w)) - 1, 12)))
    df = df.withColumn("forward_r", ratio(F.lead("px", lead).over(w), F.col("px")) - 1)
    df = df.withColumns({f"p_{k}": 0.5 + 0.5 * F.avg("move").over(w.rowsBetween(1 - k, 0)) for k in SPANS})
    df = df.where(F.col("move").isNotNull() & (F.col("forward_r") != 0)).withColumn("y", (F.col("forward_r") > 0).cast("int"))
    df = df.withColumn("rn", F.row_number().over(w).cast("long") - 1)
    long = df.select("instrument", "dt", "rn", "y", "forward_r", F.explode(F.array(*(F.struct(F.lit(f"rule{k}").alias("model"), F.col(f"p_{k}").alias("p1")) for k in SPANS))).alias("m"))
    return long.select("instrument", "m.model", "dt", "rn", "y", "forward_r", (1 - F.col("m.p1")).alias("p0"), "m.p1", (F.col("m.p1") > 1 - F.col("m.p1")).cast("int").alias("pred"))


def signals_sql(lead: int = 1) -> str:
    spans = ", ".join(f"0.5::DOUBLE + 0.5::DOUBLE * avg(move) OVER (PARTITION BY instrument ORDER BY dt ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS p_{k}" for k in SPANS)
    union = " UNION ALL ".join(f"SELECT instrument, 'rule{k}' AS model, dt, rn, y, forward_r, 1 - p_{k} AS p0, p_{k} AS p1, CAST(p_{k} > 1 - p_{k} AS INTEGER) AS pred FROM sig2" for k in SPANS)
    return (
        LEVEL
        + f""",
sig0 AS (SELECT *, CAST(sign(round(px / lag(px) OVER (PARTITION BY instrument ORDER BY dt) - 1, 12)) AS INTEGER) AS move,
  lead(px, {lead}) OVER (PARTITION BY instrument ORDER BY dt) / px - 1 AS forward_r FROM level),
sig1 AS (SELECT *, {spans} FROM sig0),
sig2 AS (SELECT instrument, dt, row_number() OVER (PARTITION BY instrument ORDER BY dt) - 1 AS rn, CAST(forward_r > 0 AS INTEGER) AS y, forward_r, p_1, p_3, p_5
  FROM sig1 WHERE move IS NOT NULL AND forward_r <> 0),
sig AS ({union})"""
    )


def predictions(spark: SparkSession, sf_dir: str, step: int | None = None, lead: int = 1) -> DataFrame:
    """Test rows of walk-forward folds (250 rows, 50 for testing)."""
    spec = folds.FoldSpec(step=step)
    sized = folds.with_size(signals(spark, sf_dir, lead), ("instrument", "model"))
    return folds.walk_forward(sized, spec).where("is_test").drop("n", "is_test")


def predictions_sql(step: int = 50, lead: int = 1) -> str:
    return (
        signals_sql(lead)
        + f""",
sized AS (SELECT *, count(*) OVER (PARTITION BY instrument, model) AS n FROM sig),
folded AS (SELECT s.*, f.fold, s.rn - f.fold * {step} AS k_at FROM sized s, range(0, 2000) f(fold)
  WHERE s.n >= 250 AND f.fold <= floor((s.n - 250) / {step}) AND s.rn >= f.fold * {step} AND s.rn < f.fold * {step} + 250),
preds AS (SELECT * FROM folded WHERE k_at >= 200)"""
    )


def positions(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    df = backtest.stitched(predictions(spark, sf_dir), ["instrument", "model"])
    df = df.withColumn("position", backtest.binary_position(F.col("p0"), F.col("p1"), threshold))
    return df.withColumn("strat", F.col("position") * F.col("forward_r"))


def positions_sql(threshold: float | None = None) -> str:
    side = "CASE WHEN p1 >= p0 THEN 1 ELSE -1 END"
    pos = side if threshold is None else f"CASE WHEN greatest(p0, p1) >= {threshold} THEN {side} ELSE 0 END"
    return (
        predictions_sql()
        + f""",
pos AS (SELECT *, position * forward_r AS strat FROM (SELECT *, {pos} AS position FROM
  (SELECT *, row_number() OVER (PARTITION BY instrument, model, dt ORDER BY fold DESC) AS k FROM preds) WHERE k = 1))"""
    )


def batches(spark: SparkSession, sf_dir: str, rows: int = 25) -> tuple[DataFrame, DataFrame]:
    """(scores, steps) of a tuning run an instrument: each block of ``rows`` rows is a batch, the rules are the variants, scored on the 50
    rows before the batch."""
    sig = signals(spark, sf_dir)
    hit = sig.select(F.col("instrument").alias("run"), F.col("model").alias("variant"), "rn", "dt", "y", "pred", (F.col("y") == F.col("pred")).cast("long").alias("correct"), "forward_r")
    at = F.explode(F.expr(f"sequence(cast(floor(rn / {rows}) as bigint) + 1, cast(floor((rn + 50) / {rows}) as bigint))"))
    scored = hit.where(f"floor(rn / {rows}) + 1 <= floor((rn + 50) / {rows})").withColumn("batch", at)
    scores = scored.groupBy("run", "batch", "variant").agg(F.avg("correct").alias("acc"), F.count("*").alias("n")).where("n = 50").drop("n")
    scores = scores.withColumn("ordinal", F.substring("variant", 5, 2).cast("int"))
    return scores, hit.withColumn("batch", F.floor(F.col("rn") / rows).cast("long"))


def batches_sql(rows: int = 25) -> str:
    return (
        signals_sql()
        + f""",
hit AS (SELECT instrument AS run, model AS variant, rn, dt, y, pred, CAST(y = pred AS BIGINT) AS correct, forward_r, rn // {rows} AS batch FROM sig),
scores AS (SELECT run, b.batch, variant, avg(correct) AS acc, CAST(substr(variant, 5, 2) AS INTEGER) AS ordinal FROM hit h, range(0, 2000) b(batch)
  WHERE h.rn >= b.batch * {rows} - 50 AND h.rn < b.batch * {rows} AND b.batch * {rows} <= (SELECT max(rn) + 50 FROM hit x WHERE x.run = h.run AND x.variant = h.variant)
  GROUP BY 1, 2, 3 HAVING count(*) = 50),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, batch ORDER BY acc DESC, ordinal) AS k FROM scores) WHERE k = 1),
numbered AS (SELECT run, batch, variant AS best, acc AS best_acc, row_number() OVER (PARTITION BY run ORDER BY batch) AS i FROM best),
chain AS (SELECT run, batch, best, best_acc, i, best AS champion FROM numbered WHERE i = 1
  UNION ALL SELECT n.run, n.batch, n.best, n.best_acc, n.i, CASE WHEN s.acc >= n.best_acc - 1e-15 THEN c.champion ELSE n.best END
  FROM chain c JOIN numbered n ON n.run = c.run AND n.i = c.i + 1 LEFT JOIN scores s ON s.run = n.run AND s.batch = n.batch AND s.variant = c.champion)"""
    )
