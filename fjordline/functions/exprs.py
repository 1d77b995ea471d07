"""Column helpers shared by the operators: null rules, safe ratios, business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """Null instead of NaN and of either infinity."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """a / b; null where |b| is at most ``least`` or either is null."""
    return F.when(F.abs(b) > least, a / b)


def pair_id(name: Column) -> Column:
    """``EUR/USD`` to ``EUR_USD``."""
    return F.translate(name, "/ ", "__")


def pair_name(pid: Column) -> Column:
    return F.replace(pid, F.lit("_"), F.lit("/"))


def basis_label(x: Column) -> Column:
    return F.when(F.lower(F.trim(x)).isin("high_low", "hl", "path"), "high_low").otherwise("close")


def add_business_days(day: Column, n: Column | int) -> Column:
    """The n-th weekday after ``day`` (n >= 1); there is no holiday calendar."""
    n = F.lit(n) if isinstance(n, int) else n
    days = F.sequence(F.date_add(day, 1), F.date_add(day, (n * 3 + 3).cast("int")))
    return F.get(F.filter(days, lambda d: F.weekday(d) < 5), n - 1)


def previous_business_day(day: Column) -> Column:
    back = F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1)
    return F.date_sub(day, back)


def sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)
