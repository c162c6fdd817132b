"""Time windows relative to an explicit ``as_of``, buckets and rounding.

``as_of`` is either a datetime or a Column (for example a scalar subquery, so
the driver never has to fetch a maximum). Nothing reads the wall clock.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = datetime | date | Column

# Partition columns that repeat the date of a time column.
DATE_COLUMNS = {
    "event_time": "event_date", "bucket_time": "bucket_date", "seen_at": "seen_date", "signal_hour": "signal_date"
}


def latest(df: DataFrame, time_col: str) -> Column:
    """Newest time of a table as a scalar subquery; reads the newest day only where days
    are partitions."""
    day = DATE_COLUMNS.get(time_col)
    if day in df.columns:
        df = df.filter(F.col(day) == df.agg(F.max(day)).scalar())
    return df.agg(F.max(time_col)).scalar()


def moment(df: DataFrame, time_col: str, as_of: AsOf) -> Column:
    """``as_of`` in the type of the time column, so the comparison reaches the scan."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return at.cast(df.schema[time_col].dataType)


def span(delta: timedelta) -> Column:
    return F.expr(f"INTERVAL '{int(delta.total_seconds())}' SECOND")


def within(
    df: DataFrame,
    time_col: str,
    as_of: AsOf,
    back: timedelta,
    *,
    upper: bool = True,
    to_second: bool = True,
) -> DataFrame:
    """Rows of ``[as_of - back, as_of]``; also filters the date partition column."""
    end = moment(df, time_col, as_of)
    if to_second:
        end = F.date_trunc("second", end).cast(df.schema[time_col].dataType)
    start = end - span(back)
    cond = F.col(time_col) >= start
    if upper:
        cond &= F.col(time_col) <= end
    day = DATE_COLUMNS.get(time_col)
    if day in df.columns:
        cond &= F.col(day) >= start.cast("date")
        if upper:
            cond &= F.col(day) <= end.cast("date")
    return df.filter(cond)


def bucket(time_col: Column | str, width: str = "5 minutes") -> Column:
    """Start of the epoch-aligned tumbling bucket."""
    return F.window(time_col, width)["start"]


def round_half_up(x: Column, digits: int) -> Column:
    """One rounding rule for every engine: floor(x * 10^n + 0.5) / 10^n."""
    f = 10**digits
    return F.floor(x * F.lit(float(f)) + F.lit(0.5)).cast("double") / F.lit(float(f))


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """Share in percent; 0 when there is nothing to share."""
    p = part.cast("double") / total.cast("double") * 100.0
    return F.when(total > 0, round_half_up(p, digits)).otherwise(F.lit(0.0))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)
