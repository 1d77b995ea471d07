"""Session days that roll at 17:00 New York; business days are Monday to Friday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import add_business_days, previous_business_day

ZONE, ROLL_HOUR = "America/New_York", 17


def new_york(utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc.cast("timestamp_ntz"))


def session_dates(ny: Column) -> tuple[Column, Column]:
    """(data through, target): from 17:00 on a weekday today and the next business day, before that the previous business day and
    the one after it."""
    day = F.to_date(ny)
    rolled = (F.weekday(day) < 5) & (F.hour(ny) >= ROLL_HOUR)
    through = F.when(rolled, day).otherwise(previous_business_day(day))
    return through, add_business_days(through, 1)


def forecast_date(feature_date: Column, lead: int, aligned_target: Column | None = None) -> Column:
    return aligned_target if aligned_target is not None else add_business_days(feature_date, lead)
