"""Streaming forms of the ingest and alert queries (plain DataFrame transforms).

The watermark bounds the state of ``dedup_stream`` only: a row later than that
is dropped by it. Where every row counts, ``jobs.ingest_events`` stores rows of
any delay and drops repeated ones by the stored table instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.operators import merge
from edgeline.operators.alerts import credential_stuffing_groups

LB_KEYS = ["tenant_id", "lb_namespace", "lb_name"]
LATE = f"{settings.LATE_MINUTES} minutes"


def overlapping_pull(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Accept rows as late as the overlap between two pulls."""
    return stream.withWatermark("event_time", late)


def dedup_stream(stream: DataFrame) -> DataFrame:
    """Each event of an owner once; needs the watermark of ``overlapping_pull``."""
    return stream.dropDuplicatesWithinWatermark(merge.EVENT_KEYS)


def stuffing_counts(
    bot_events: DataFrame, *, width: str = "10 minutes", slide: str = "5 minutes"
) -> DataFrame:
    """Attempts per address and sliding window, whatever the thresholds."""
    windows = F.window("event_time", width, slide)
    rows = credential_stuffing_groups(bot_events.withColumn("w", windows), ["w"], 0, 0.0)
    return rows.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "tenant_id",
        "source_ip",
        "source_country",
        "source_asn",
        "total",
        "failed",
        "any_endpoint",
    )


def stuffing_alerts(
    counts: DataFrame,
    *,
    min_events: int = settings.ALERT_CRED_STUFFING_MIN_EVENTS,
    failure_pct: float = settings.ALERT_CRED_STUFFING_FAILURE_PCT,
) -> DataFrame:
    """The windows in which the credential-stuffing rule holds."""
    return counts.filter(
        (F.col("total") >= min_events) & (F.col("failed") * 100.0 >= F.col("total") * failure_pct)
    )
