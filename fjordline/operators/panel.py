"""Feature panels: calendar joins, forward fills, trims and filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_instrument(*order: str) -> Window:
    return Window.partitionBy("instrument").orderBy(*(order or ("dt",)))


def join_exact_filled(bars: DataFrame, shared: DataFrame, columns: list[str], on: list[str], limit: int | None = None) -> DataFrame:
    """Left equi-join on the bar calendar, then forward fill (at most ``limit`` rows). Values on days without a bar are lost."""
    df = bars.join(shared.select(*on, *columns), on, "left")
    w = by_instrument().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def join_as_of(bars: DataFrame, shared: DataFrame, columns: list[str]) -> DataFrame:
    """The latest shared value on or before each bar's day, off-calendar days included: bars and values are put in one series per
    instrument and filled forwards, so no range join is needed."""
    # shared rows are dealt to every instrument: (instruments x days), the size of the panel itself
    names = bars.agg(F.collect_set("instrument")).scalar()
    rows = shared.select(F.col("dt").alias("day"), *columns).withColumn("instrument", F.explode(names))
    marks = bars.select("instrument", "dt", F.lit(1).alias("is_bar"), *(F.lit(None).cast(dict(shared.dtypes)[c]).alias(c) for c in columns))
    both = marks.unionByName(rows.select("instrument", F.col("day").alias("dt"), F.lit(0).alias("is_bar"), *columns))
    w = by_instrument("dt", "is_bar").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).where("is_bar = 1").drop("is_bar")
    return bars.join(filled, ["instrument", "dt"], "left")


def trim_period(df: DataFrame, period: str) -> DataFrame:
    """Rows from max(dt) - N days on, per instrument; ``Nd``, ``Ny`` (365 days a year) or ``max``."""
    if period == "max":
        return df
    m = re.fullmatch(r"(\d+)([dy])", period.strip().lower())
    if not m:
        raise ValueError(f"unknown period {period!r}")
    days = int(m[1]) * (365 if m[2] == "y" else 1)
    top = F.max("dt").over(Window.partitionBy("instrument"))
    return df.withColumn("_top", top).where(F.col("dt") >= F.date_sub("_top", days)).drop("_top")


def last_rows(df: DataFrame, n: int, until: Column | None = None) -> DataFrame:
    """The last ``n`` rows of each instrument, on or before ``until`` if given."""
    df = df if until is None else df.where(F.col("dt") <= until)
    return df.withColumn("_k", F.row_number().over(by_instrument(F.desc("dt")))).where(F.col("_k") <= n).drop("_k")


def drop_sparse_rows(df: DataFrame, columns: list[str], share: float = 0.25, least: int = 5) -> DataFrame:
    """Rows with at least max(min(int(share * n), n), least) non-null values among ``columns``."""
    n = len(columns)
    return df.na.drop(thresh=max(min(int(share * n), n), least), subset=columns)


def non_null_shares(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, share): one aggregation, then unpivoted."""
    keys = keys or []
    wide = df.groupBy(*keys).agg(*((F.count(c) / F.count("*")).alias(c) for c in columns))
    return wide.unpivot(keys, columns, "feature", "share")


def kept_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose non-null share reaches 0.05 (fewer than 400 rows) or 0.12."""
    row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns)).first()
    least = 0.05 if row["n"] < 400 else 0.12
    return [c for c in columns if row["n"] and row[c] and row[c] / row["n"] >= least]


def columns_like(df: DataFrame, prefixes: tuple[str, ...], drop_suffixes: tuple[str, ...] = ("_close",)) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes) and not c.endswith(drop_suffixes)]


def drop_empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without those of ``columns`` that hold no value, found in one aggregation."""
    row = df.agg(*(F.count(f"`{c}`").alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if not row[c]))


def until_session(df: DataFrame, utc: Column) -> DataFrame:
    """Rows on or before the session day whose data are complete at ``utc``."""
    from .calendar import new_york, session_dates

    return df.where(F.col("dt") <= session_dates(new_york(utc))[0])


def usable_rows(df: DataFrame, features: list[str], label: str = "y", forward: str = "forward_r", keep_unlabelled: bool = False) -> DataFrame:
    some = F.greatest(*(F.col(c).isNotNull().cast("int") for c in features), F.lit(0), F.lit(0))
    ok = some == 1
    return df.where(ok if keep_unlabelled else ok & F.col(label).isNotNull() & F.col(forward).isNotNull())


def row_guard(df: DataFrame, least: int = 80) -> DataFrame:
    """(instrument, n_rows, status): ``ok`` or ``too_few_rows``."""
    return df.groupBy("instrument").agg(F.count("*").alias("n_rows")).withColumn("status", F.when(F.col("n_rows") < least, "too_few_rows").otherwise("ok"))
