"""Forward returns, path excursions and labels; all leads in one window pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean, ratio
from .panel import by_instrument

BAND = 0.005


def forward_return(lead: int, close: str = "close") -> Column:
    """close[t + lead] / close[t] - 1 over rows."""
    return ratio(F.lead(close, lead).over(by_instrument()), F.col(close)) - 1


def forward_returns(df: DataFrame, leads: range, close: str = "close") -> DataFrame:
    return df.withColumns({f"r{k}": forward_return(k, close) for k in leads})


def binary_label(r: Column) -> Column:
    """1 up, 0 down; a return of exactly zero is unlabelled."""
    return F.when(r > 0, 1).when(r < 0, 0)


def ternary_label(r: Column, band: float = BAND) -> Column:
    return F.when(r < -band, 0).when(r <= band, 1).when(r > band, 2)


def excursion_columns(lead: int, high: str = "high", low: str = "low", close: str = "close") -> tuple[Column, Column, Column]:
    """(highest, lowest and last move) over rows t+1 .. t+lead; null unless all highs and lows there are known."""
    ahead = by_instrument().rowsBetween(1, lead)
    h, l, c = clean(F.col(high)), clean(F.col(low)), clean(F.col(close))
    whole = (F.count(h).over(ahead) == lead) & (F.count(l).over(ahead) == lead) & (F.abs(c) >= 1e-18)
    return F.when(whole, F.max(h).over(ahead) / c - 1), F.when(whole, F.min(l).over(ahead) / c - 1), F.when(whole, F.lead(c, lead).over(by_instrument()) / c - 1)


def excursions(df: DataFrame, lead: int) -> DataFrame:
    """Append hi_exc, lo_exc and close_ret."""
    return df.withColumns(dict(zip(("hi_exc", "lo_exc", "close_ret"), excursion_columns(lead), strict=True)))


def path_binary(hi: Column, lo: Column, r: Column) -> Column:
    """The larger excursion decides, equal ones are up; without excursions the close return decides."""
    return F.when((hi >= F.abs(lo)) & (hi > 0), 1).when((F.abs(lo) > hi) & (lo < 0), 0).otherwise(binary_label(r))


def path_ternary(hi: Column, lo: Column, band: float = BAND) -> Column:
    up, down = hi > band, lo < -band
    return F.when(hi.isNull() | lo.isNull(), None).when(up & down, F.when(hi >= F.abs(lo), 2).otherwise(0)).when(up, 2).when(down, 0).otherwise(1)
