"""Firewall event queries, for all tenants in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions.ranking import top_per_group
from edgeline.functions.timewin import AsOf
from edgeline.operators import series as Q

TOPK_DIMS = ["source_ip", "source_country", "primary_signature", "url", "lb_name", "action"]
# error_count has always counted allowed rows; ``allowed`` is the clear name for it
POINT_COUNTERS = {"BLOCK": "blocked_count", "MONITOR": "monitored_count", "ALLOW": "error_count"}


def waf_overview(
    events: DataFrame, *, as_of: AsOf, minutes: int = 60, tenants: DataFrame | None = None
) -> DataFrame:
    totals = {"BLOCK": "total_blocked", "MONITOR": "total_monitored", "ALLOW": "total_errors"}
    out = Q.per_tenant(
        Q.windowed(events, as_of, minutes=minutes),
        [F.count("*").alias("total_requests"), *Q.action_counts(totals)],
        tenants,
    )
    return _overview_rates(out)


def _overview_rates(totals: DataFrame) -> DataFrame:
    return totals.withColumn("allowed", F.col("total_errors")).withColumn(
        "block_rate_pct", Q.rate("total_blocked", "total_requests")
    )


def waf_overview_of(counters: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """The overview from ``continuous.window_counters`` of the firewall tables."""
    names = {
        "request_count": "total_requests",
        "blocked_count": "total_blocked",
        "monitored_count": "total_monitored",
        "error_count": "total_errors",
    }
    return _overview_rates(Q.per_tenant(counters, [F.sum(c).alias(n) for c, n in names.items()], tenants))


def waf_sparkline(
    events: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    lbs: DataFrame | None = None,
    per_lb: bool = False,
) -> DataFrame:
    rows = Q.windowed(events, as_of, lbs, hours=hours)
    return Q.sparkline(rows, POINT_COUNTERS, by=Q.LB_KEYS if per_lb else None)


def waf_topk(
    events: DataFrame,
    dim: str,
    *,
    as_of: AsOf,
    hours: int = 24,
    action: str | None = None,
    lbs: DataFrame | None = None,
    k: int = settings.TOP_K,
) -> DataFrame:
    if dim not in TOPK_DIMS:
        raise ValueError(f"unknown dimension {dim}")
    where = F.col("action") == action.upper() if action else None
    return Q.count_topk(Q.windowed(events, as_of, lbs, hours=hours), dim, k, where=where)


def recent_waf_events(
    events: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    action: str | None = None,
    severity: str | None = None,
    lbs: DataFrame | None = None,
    limit: int = 200,
) -> DataFrame:
    """Newest events of each tenant."""
    rows = Q.windowed(events, as_of, lbs, hours=hours)
    if action:
        rows = rows.filter(F.col("action") == action.upper())
    if severity:
        rows = rows.filter(F.col("severity") == severity.lower())
    cols = [
        "tenant_id",
        "id",
        "event_time",
        "lb_namespace",
        "lb_name",
        "action",
        "source_ip",
        "source_country",
        "method",
        "url",
        "response_code",
        "primary_signature",
        "severity",
    ]
    return top_per_group(
        rows.select(*cols), Q.TENANT, [F.desc("event_time"), F.asc("id")], limit
    )


def firewall_violations(points: DataFrame) -> DataFrame:
    """Chart column of the firewall series."""
    return points.withColumn("violations", F.col("blocked_count") + F.col("monitored_count"))


def policy_traffic(
    attachments: DataFrame,
    events: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    policy_type: str = "app_firewall",
) -> DataFrame:
    """Five-minute series of a policy, summed over the load balancers it is attached to.

    Events are first reduced to one row per load balancer and bucket, so the
    join with the attachments multiplies counters, not events.
    """
    points = waf_sparkline(events, as_of=as_of, hours=hours, per_lb=True)
    links = attachments.filter(F.col("policy_type") == policy_type)
    keys = ["tenant_id", "policy_namespace", "policy_name", "bucket_time"]
    counters = ["request_count", *POINT_COUNTERS.values()]
    return (
        points.join(links, Q.LB_KEYS).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    )
