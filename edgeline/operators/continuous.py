"""Hour tables read together with what is newer: whole stored hours, and finer rows for the rest.

The mark of an hour table is the end of its stored hours, kept as text in a
versioned table beside it. Hours before the mark are complete and stay right:
late minutes recompute the hours they fall into. Hours from the mark on are
counted from the minutes when they are read. A window that starts or ends inside
an hour takes minutes there, and events inside a minute, so its counters equal
those of the events themselves, whatever the mark.

Hours and minutes partitioned by date and hour are pruned by both; the mark is a
literal. A reader takes the mark before it opens the tables: ``advance`` writes
only hours that no earlier mark covers and moves the mark last, so a job that
dies in between leaves the old mark, and its repeat replaces the same hours.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions.timewin import DATE_COLUMNS, AsOf, bucket, moment, span
from edgeline.operators import rollups, tables
from edgeline.operators import series as Q
from edgeline.sources.landing import partitions

Rollup = Callable[[DataFrame], DataFrame]
# the mark of an hour table without stored hours; before every time
NO_HOURS = "0001-01-01 00:00:00"


def _marks(spark: SparkSession, hour_path: str) -> tables.SnapshotTable:
    return tables.SnapshotTable(spark, hour_path.rstrip("/") + "_mark", "until string")


def mark(spark: SparkSession, hour_path: str) -> str:
    """End of the stored hours."""
    row = _marks(spark, hour_path).read().first()
    return row["until"] if row else NO_HOURS


def _hour(df: DataFrame) -> Column:
    """Hour of a row; of a partitioned table told from the partition alone, so that a filter on it prunes."""
    kind = df.schema["bucket_time"].dataType
    if {*partitions("bucket_time")} <= {*df.columns}:
        return F.expr("bucket_date + make_dt_interval(0, bucket_hour)").cast(kind)
    return F.date_trunc("hour", "bucket_time").cast(kind)


def _at(df: DataFrame, text: str) -> Column:
    return F.lit(text).cast(df.schema["bucket_time"].dataType)


def refresh_hours(touched: DataFrame, minute_path: str, hour_path: str, rollup: Rollup) -> None:
    """Recompute the hours of the touched minutes; only the days of these hours are read."""
    hours = rollups.hours_to_refresh(touched)
    minutes = touched.sparkSession.read.parquet(minute_path)
    minutes = tables.on_days(minutes, "bucket_time", tables.days_of(hours, "hour"))
    minutes = minutes.drop(*partitions("bucket_time"))
    tables.replace_buckets(rollups.recompute_hours(minutes, hours, rollup), hour_path)


def correct(touched: DataFrame, minute_path: str, hour_path: str, rollup: Rollup) -> None:
    """Recompute the stored hours that late minutes fall into; those from the mark on are not stored."""
    late = touched.filter(F.col("bucket_time") < _at(touched, mark(touched.sparkSession, hour_path)))
    if not late.isEmpty():
        refresh_hours(late, minute_path, hour_path, rollup)


def advance(
    spark: SparkSession,
    minute_path: str,
    hour_path: str,
    rollup: Rollup,
    *,
    as_of: AsOf,
    lag_hours: int = settings.ROLLUP_LAG_HOURS,
) -> str:
    """Store the whole hours between the mark and ``as_of - lag``; returns the new mark, which never goes back."""
    old = mark(spark, hour_path)
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    end = F.date_trunc("hour", at - span(timedelta(hours=lag_hours)))
    new = spark.range(1).select(F.date_format(end, "yyyy-MM-dd HH:mm:ss")).first()[0]
    if new is None or new <= old:
        return old
    minutes = spark.read.parquet(minute_path)
    hour = _hour(minutes)
    fresh = minutes.filter((hour >= _at(minutes, old)) & (hour < _at(minutes, new)))
    tables.replace_buckets(rollup(fresh.drop(*partitions("bucket_time"))), hour_path)
    _marks(spark, hour_path).write(spark.createDataFrame([(new,)], "until string"))
    return new


def live_hours(hours: DataFrame, minutes: DataFrame, rollup: Rollup, *, mark: str) -> DataFrame:
    """All hours: stored ones before the mark, those behind it rolled up from the minutes."""
    tail = rollup(minutes.filter(_hour(minutes) >= _at(minutes, mark)))
    return hours.filter(_hour(hours) < _at(hours, mark)).select(*tail.columns).unionByName(tail)


def _ceil(at: Column, unit: str, kind) -> Column:
    width = {"minute": "59.999999", "hour": "3599.999999"}[unit]
    return F.date_trunc(unit, at + F.expr(f"INTERVAL '{width}' SECOND")).cast(kind)


def _whole_minutes(minutes: DataFrame, first: Column, final: Column) -> DataFrame:
    kind = minutes.schema["bucket_time"].dataType
    t, hour = F.col("bucket_time"), _hour(minutes)
    inside = (t >= first) & (t < final)
    return minutes.filter(inside & (hour >= F.date_trunc("hour", first).cast(kind)) & (hour < final))


def hours_and_minutes(
    hours: DataFrame, minutes: DataFrame, *, mark: str, first: Column, final: Column, cols: list[str], as_minutes: Rollup
) -> DataFrame:
    """Rows of ``cols`` that add up to the minutes of ``[first, final)``: stored whole hours, and minutes elsewhere.

    ``as_minutes`` brings minute rows to the columns of the hours.
    """
    kind = minutes.schema["bucket_time"].dataType
    begin = _ceil(first, "hour", kind)
    stop = F.least(F.date_trunc("hour", final).cast(kind), _at(minutes, mark))
    of_hours, of_minutes = _hour(hours), _hour(minutes)
    rest = _whole_minutes(minutes, first, final).filter(~((of_minutes >= begin) & (of_minutes < stop)))
    stored = hours.filter((of_hours >= begin) & (of_hours < stop))
    return stored.select(*cols).unionByName(as_minutes(rest).select(*cols))


def _window(df: DataFrame, time_col: str, as_of: AsOf, back: timedelta) -> tuple[Column, Column, Column, Column]:
    """(start, end) of ``[as_of - back, as_of]`` to the second, and (first, final) of the whole minutes inside."""
    kind = df.schema[time_col].dataType
    end = F.date_trunc("second", moment(df, time_col, as_of)).cast(kind)
    start = end - span(back)
    return start, end, _ceil(start, "minute", kind), F.date_trunc("minute", end).cast(kind)


def _cut_minutes(events: DataFrame, as_of: AsOf, back: timedelta) -> DataFrame:
    """Events of the window outside its whole minutes: less than a minute at either end."""
    start, end, first, final = _window(events, "event_time", as_of, back)
    t = F.col("event_time")
    rows = events.filter((t >= start) & (t <= end) & ((t < first) | (t >= final)))
    day = DATE_COLUMNS["event_time"]
    if day in events.columns:
        rows = rows.filter(F.col(day).isin(*[x.cast("date") for x in (start, first, final, end)]))
    return rows


def _filtered(rows: DataFrame, lbs: DataFrame | None) -> DataFrame:
    return Q.lb_filter(rows, lbs) if lbs is not None else rows


def window_counters(
    hours: DataFrame,
    minutes: DataFrame,
    events: DataFrame,
    count: Rollup,
    *,
    mark: str,
    as_of: AsOf,
    back: timedelta,
    lbs: DataFrame | None = None,
) -> DataFrame:
    """Counters per load balancer that add up to those of all events of ``[as_of - back, as_of]``.

    ``count`` makes minute rows of events, such as ``rollups.minute_metrics``.
    """
    cut = count(_cut_minutes(events, as_of, back))
    cols = [*Q.LB_KEYS, *[c for c in cut.columns if c.endswith("_count")]]
    _, _, first, final = _window(minutes, "bucket_time", as_of, back)
    stored = hours_and_minutes(hours, minutes, mark=mark, first=first, final=final, cols=cols, as_minutes=lambda m: m)
    return _filtered(stored.unionByName(cut.select(*cols)), lbs)


def window_points(
    minutes: DataFrame,
    events: DataFrame,
    count: Rollup,
    *,
    as_of: AsOf,
    back: timedelta,
    by: list[str] | None = None,
    lbs: DataFrame | None = None,
) -> DataFrame:
    """Five-minute series of the window from minutes, and from events in the minutes that the window cuts."""
    cut = count(_cut_minutes(events, as_of, back))
    counters = [c for c in cut.columns if c.endswith("_count")]
    cols = ["bucket_time", *Q.LB_KEYS, *counters]
    _, _, first, final = _window(minutes, "bucket_time", as_of, back)
    rows = _filtered(_whole_minutes(minutes, first, final).select(*cols).unionByName(cut.select(*cols)), lbs)
    points = rows.groupBy(*(by or Q.TENANT), bucket("bucket_time").alias("b5"))
    return points.agg(*[F.sum(c).alias(c) for c in counters]).withColumnRenamed("b5", "bucket_time")


def window_traffic(hours: DataFrame, metrics: DataFrame, *, mark: str, as_of: AsOf, minutes: int) -> DataFrame:
    """API traffic per load balancer over the minutes of the window, from ``rollups.api_traffic_1hour``."""
    _, _, first, final = _window(metrics, "bucket_time", as_of, timedelta(minutes=minutes))
    return hours_and_minutes(
        hours,
        metrics,
        mark=mark,
        first=first,
        final=final + span(timedelta(minutes=1)),
        cols=[*Q.LB_KEYS, *rollups.TRAFFIC],
        as_minutes=rollups.api_traffic_1hour,
    )
