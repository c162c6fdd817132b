"""Distinct counts over sliding windows, from one theta sketch per hour.

A sketch of 2^size values is exact up to that many distinct values and has a
relative standard error of about 2^(-size/2) beyond. Hours merge in any order, so
late rows only need the sketch of their own rows added. ``series.distinct_counts``
is the exact form. Null values are not counted.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions.timewin import DATE_COLUMNS, AsOf, bucket, moment, span
from edgeline.operators.series import TENANT

SIZE = 14
HOUR = "signal_hour"


def distinct_hours(events: DataFrame, columns: list[str], size: int = SIZE) -> DataFrame:
    """(tenant, signal_hour, name, sketch): the values of each column in each hour."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    hour = bucket("event_time", "1 hour").alias(HOUR)
    values = events.select(*TENANT, hour, F.inline(pairs)).filter("value is not null")
    return values.groupBy(*TENANT, HOUR, "name").agg(F.theta_sketch_agg("value", size).alias("sketch"))


def merged(*parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Hours of several tables as one: sketches of one hour and column are united."""
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*TENANT, HOUR, "name").agg(F.theta_union_agg("sketch", size).alias("sketch"))


def _in_hours(hours: DataFrame, as_of: AsOf, newest: int, oldest: int) -> DataFrame:
    """Hours from ``oldest`` to ``newest`` before the one of ``as_of``; prunes by date where it is a column."""
    kind = hours.schema[HOUR].dataType
    now = F.date_trunc("hour", moment(hours, HOUR, as_of)).cast(kind)
    first, last = now - span(timedelta(hours=oldest)), now - span(timedelta(hours=newest))
    inside = F.col(HOUR).between(first, last)
    day = DATE_COLUMNS[HOUR]
    return hours.filter(inside & F.col(day).between(first.cast("date"), last.cast("date")) if day in hours.columns else inside)


def _united(rows: DataFrame, name: str, size: int) -> DataFrame:
    return rows.groupBy(*TENANT, "name").agg(F.theta_union_agg("sketch", size).alias(name))


def distinct_over(hours: DataFrame, *, as_of: AsOf, window_hours: int, size: int = SIZE) -> DataFrame:
    """(tenant, name, distinct_values) over the hour of ``as_of`` and those before it, ``window_hours`` in all."""
    rows = _united(_in_hours(hours, as_of, 0, window_hours - 1), "sketch", size)
    return rows.select(*TENANT, "name", F.theta_sketch_estimate("sketch").alias("distinct_values"))


def new_against(hours: DataFrame, *, as_of: AsOf, window_hours: int, prior_hours: int, size: int = SIZE) -> DataFrame:
    """(tenant, name, distinct_values, new_values): values of the window, and those not seen in the hours before it."""
    recent = _united(_in_hours(hours, as_of, 0, window_hours - 1), "recent", size)
    prior = _united(_in_hours(hours, as_of, window_hours, window_hours + prior_hours - 1), "prior", size)
    estimate: Column = F.theta_sketch_estimate("recent")
    fresh = F.when(F.col("prior").isNull(), estimate).otherwise(F.theta_sketch_estimate(F.theta_difference("recent", "prior")))
    return recent.join(prior, [*TENANT, "name"], "left").select(
        *TENANT, "name", estimate.alias("distinct_values"), fresh.alias("new_values")
    )
