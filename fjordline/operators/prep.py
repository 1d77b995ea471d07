"""Preprocessing fitted on training rows only; features travel in long form (keys, pos, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, columns, "feature", "v")


def median_impute(rows: DataFrame, fold: list[str]) -> DataFrame:
    """Null values become the exact training median of their (fold, feature); features without any training value go."""
    train = rows.where(~F.col("is_test")).groupBy(*fold, "feature").agg(F.median("v").alias("med"))
    return rows.join(train.where("med IS NOT NULL"), [*fold, "feature"]).withColumn("v", F.coalesce("v", "med")).drop("med")


def standardize(rows: DataFrame, fold: list[str]) -> DataFrame:
    """Centre and scale by training mean and population deviation; a constant feature keeps scale 1."""
    stats = rows.where(~F.col("is_test")).groupBy(*fold, "feature").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    z = (F.col("v") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return rows.join(stats, [*fold, "feature"]).withColumn("v", z).drop("mu", "sd")


def class_weights(rows: DataFrame, fold: list[str], label: str = "y") -> DataFrame:
    """(fold, label, n_class, weight): n / (k * n_class) over training rows."""
    train = rows.where(~F.col("is_test")).groupBy(*fold, label).agg(F.count("*").alias("n_class"))
    w = Window.partitionBy(*fold)
    return train.withColumn("weight", F.sum("n_class").over(w) / (F.count("*").over(w) * F.col("n_class")))


def remap_labels(rows: DataFrame, fold: list[str], label: str = "y") -> DataFrame:
    """(fold, label, class): sorted distinct labels to 0 .. k-1."""
    seen = rows.groupBy(*fold).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return seen.select(*fold, F.posexplode("labels").alias("class", label))
