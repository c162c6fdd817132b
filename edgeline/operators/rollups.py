"""One-minute counters from events and one-hour rollups of one-minute metrics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions.timewin import DATE_COLUMNS, AsOf, bucket, moment, span

LB_KEYS = ["tenant_id", "lb_namespace", "lb_name"]


def minute_metrics(events: DataFrame) -> DataFrame:
    """Firewall counters per minute and load balancer, from the event rows.

    ``error_count`` counts allowed rows, as the overview and sparkline do.
    """
    action = F.col("action")
    return events.groupBy(bucket("event_time", "1 minute").alias("bucket_time"), *LB_KEYS).agg(
        F.count("*").alias("request_count"),
        F.count_if(action == "BLOCK").alias("blocked_count"),
        F.count_if(action == "MONITOR").alias("monitored_count"),
        F.count_if(action == "ALLOW").alias("error_count"),
    )


def bot_minute_metrics(events: DataFrame) -> DataFrame:
    action = F.col("action")
    return events.groupBy(bucket("event_time", "1 minute").alias("bucket_time"), *LB_KEYS).agg(
        F.count("*").alias("request_count"),
        F.count_if(action == "CHALLENGE").alias("challenge_count"),
        F.count_if(action == "BLOCK").alias("block_count"),
        F.count_if(action == "ALLOW").alias("allow_count"),
    )


def refresh_bounds(
    metrics: DataFrame,
    as_of: AsOf,
    days: int = settings.ROLLUP_LOOKBACK_DAYS,
    lag_hours: int = settings.ROLLUP_LAG_HOURS,
) -> tuple[Column, Column]:
    """Whole hours inside ``[as_of - days, as_of - lag)``."""
    at = F.date_trunc("second", moment(metrics, "bucket_time", as_of))
    kind = metrics.schema["bucket_time"].dataType
    start = F.date_trunc("hour", at - span(timedelta(days=days)) + span(timedelta(seconds=3599)))
    end = F.date_trunc("hour", at - span(timedelta(hours=lag_hours)))
    return start.cast(kind), end.cast(kind)


def _rollup(
    metrics: DataFrame, keys: list[str], aggs: list[Column], bounds: tuple[Column, Column] | None
) -> DataFrame:
    if bounds:
        start, end = bounds
        metrics = metrics.filter((F.col("bucket_time") >= start) & (F.col("bucket_time") < end))
        day = DATE_COLUMNS["bucket_time"]
        if day in metrics.columns:
            metrics = metrics.filter(
                (F.col(day) >= start.cast("date")) & (F.col(day) <= end.cast("date"))
            )
    hour = bucket("bucket_time", "1 hour").alias("bucket_time")
    return metrics.groupBy(hour, *keys).agg(*aggs)


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def waf_rollup_1hour(metrics: DataFrame, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    names = ("request_count", "blocked_count", "monitored_count", "error_count")
    return _rollup(metrics, LB_KEYS, _sums(*names), bounds)


def bot_rollup_1hour(metrics: DataFrame, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    names = ("request_count", "challenge_count", "block_count", "allow_count")
    return _rollup(metrics, LB_KEYS, _sums(*names), bounds)


def api_rollup_1hour(metrics: DataFrame, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Counts are summed; p95 and p99 are the worst minute, not true percentiles."""
    return _rollup(
        metrics,
        [*LB_KEYS, "method", "endpoint_path"],
        [
            *_sums("request_count", "error_4xx_count", "error_5xx_count"),
            F.avg("latency_p50_ms").alias("latency_p50_avg_ms"),
            F.max("latency_p95_ms").alias("latency_p95_max_ms"),
            F.max("latency_p99_ms").alias("latency_p99_max_ms"),
        ],
        bounds,
    )


TRAFFIC = ["request_count", "error_count", "latency_p99_sum", "latency_p99_minutes"]


def api_traffic_1hour(metrics: DataFrame, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """What the API overview adds up, per load balancer: sums and numbers in place of means."""
    p99 = F.col("latency_p99_ms")
    errors = F.sum(F.col("error_4xx_count") + F.col("error_5xx_count"))
    aggs = [F.sum("request_count"), errors, F.sum(p99), F.count(p99)]
    return _rollup(metrics, LB_KEYS, [a.alias(n) for a, n in zip(aggs, TRAFFIC, strict=True)], bounds)


def hours_to_refresh(touched: DataFrame) -> DataFrame:
    """Hours a batch of late or new metrics falls into."""
    return touched.select(bucket("bucket_time", "1 hour").alias("hour")).distinct()


def recompute_hours(metrics: DataFrame, hours: DataFrame, rollup) -> DataFrame:
    """Rollup rows of the given hours, recomputed from the whole minute table."""
    tagged = metrics.withColumn("hour", F.date_trunc("hour", "bucket_time"))
    if metrics.schema["bucket_time"].dataType.typeName() == "timestamp_ntz":
        tagged = tagged.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    keep = tagged.join(hours, "hour", "left_semi").drop("hour")
    return rollup(keep)
