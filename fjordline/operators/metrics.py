"""Classification metrics of prediction tables (keys, y, pred, p0, p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 2.220446049250313e-16


def accuracy(preds: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy and balanced accuracy (mean recall over the classes present)."""
    by_class = preds.groupBy(*keys, "y").agg(F.count("*").alias("n"), F.sum((F.col("pred") == F.col("y")).cast("long")).alias("hit"))
    return by_class.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))


def roc_auc(preds: DataFrame, keys: list[str], score: str = "p1") -> DataFrame:
    """Mann-Whitney with mid-ranks, from counts of tied scores: rows of one score are aggregated before any ordering. Null for one class."""
    tied = preds.groupBy(*keys, score).agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.count("*").alias("c"))
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = tied.withColumn("mid", F.coalesce(F.sum("c").over(below), F.lit(0)) + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("pos").alias("pos"), (F.sum("c") - F.sum("pos")).alias("neg"), F.sum(F.col("pos") * F.col("mid")).alias("ranks"))
    auc = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return sums.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), auc).alias("roc_auc"))


def log_loss_and_f1(preds: DataFrame, keys: list[str]) -> DataFrame:
    """log loss of the labelled class (clipped and renormalised) and F1 of class 1; an empty denominator gives 0."""
    clip = lambda p: F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    own = F.when(F.col("y") == 1, clip("p1")).otherwise(clip("p0")) / (clip("p0") + clip("p1"))
    count = lambda a, b: F.sum(((F.col("pred") == a) & (F.col("y") == b)).cast("long"))
    df = preds.groupBy(*keys).agg(F.avg(-F.ln(own)).alias("log_loss"), count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 1).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return df.select(*keys, "log_loss", "tp", "fp", "fn", F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0).alias("f1"))


def f1_macro(preds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f1): mean F1 over the classes that occur as label or prediction; a class without a hit counts as 0."""
    sides = preds.select(*keys, F.explode(F.array(F.struct(F.col("y").cast("int").alias("c"), F.lit(1).alias("is_y")), F.struct(F.col("pred").cast("int").alias("c"), F.lit(0).alias("is_y")))).alias("s"), (F.col("y") == F.col("pred")).cast("int").alias("hit"))
    by_class = sides.groupBy(*keys, "s.c").agg((2 * F.sum(F.col("hit") * F.col("s.is_y")) / F.count("*")).alias("f"))
    return by_class.groupBy(*keys).agg(F.avg("f").alias("f1"))


def result_rows(preds: DataFrame, keys: list[str], lead: int, target: str, n_features: int) -> DataFrame:
    """One row of results for each of ``keys`` (model and instrument among them): metrics of the training and the test part of ``preds`` (is_test) in the fixed schema."""
    by = [*keys, "is_test"]
    parts = accuracy(preds, by).join(roc_auc(preds, by), by).join(log_loss_and_f1(preds, by), by)
    names = ("accuracy", "balanced_accuracy", "roc_auc", "log_loss", "f1")
    own = lambda test, c: F.max(F.when(F.col("is_test") == test, F.col(c)))
    wide = parts.groupBy(*keys).agg(own(False, "n").cast("int").alias("n_train"), own(True, "n").cast("int").alias("n_test"), *(own(t, m).alias(f"{p}_{m}") for p, t in (("train", False), ("test", True)) for m in names))
    return wide.withColumns({"lead": F.lit(lead), "target": F.lit(target), "n_features": F.lit(n_features), "extra": F.lit(None).cast("map<string,string>")})


def ensemble_mean(preds: DataFrame, row: list[str]) -> DataFrame:
    """Mean of the members' probabilities; needs two members; ties go to the lowest class."""
    df = preds.groupBy(*row).agg(F.avg("p0").alias("p0"), F.avg("p1").alias("p1"), F.count("*").alias("members"), F.min("y").alias("y"), F.min("forward_r").alias("forward_r"))
    return df.where("members >= 2").withColumn("pred", (F.col("p1") > F.col("p0")).cast("int"))


def ensemble_weighted(preds: DataFrame, weights: DataFrame, row: list[str], on: list[str]) -> DataFrame:
    """Mean weighted by max(0, training accuracy); rows whose weights sum to nothing go."""
    df = preds.join(weights.select(*on, F.greatest(F.col("accuracy"), F.lit(0.0)).alias("w")), on)
    df = df.groupBy(*row).agg(F.sum("w").alias("w"), *((F.sum(F.col("w") * F.col(p))).alias(p) for p in ("p0", "p1")), F.count("*").alias("members"), F.min("y").alias("y"))
    df = df.where((F.col("w") > 1e-12) & (F.col("members") >= 2)).withColumns({p: F.col(p) / F.col("w") for p in ("p0", "p1")})
    return df.withColumn("pred", (F.col("p1") > F.col("p0")).cast("int"))
