"""Bot event queries, for all tenants in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions.ranking import commonest, top_per_group
from edgeline.functions.timewin import AsOf
from edgeline.operators import series as Q

TOPK_DIMS = [
    "source_ip",
    "source_country",
    "ua_family",
    "endpoint_path",
    "challenge_result",
    "bot_category",
    "action",
    "lb_name",
    "source_asn",
]
POINT_COUNTERS = {"CHALLENGE": "challenge_count", "BLOCK": "block_count", "ALLOW": "allow_count"}


def bot_overview(
    events: DataFrame, *, as_of: AsOf, minutes: int = 60, tenants: DataFrame | None = None
) -> DataFrame:
    totals = {"CHALLENGE": "total_challenges", "BLOCK": "total_blocks", "ALLOW": "total_allows"}
    out = Q.per_tenant(
        Q.windowed(events, as_of, minutes=minutes),
        [F.count("*").alias("total_requests"), *Q.action_counts(totals)],
        tenants,
    )
    return _overview_rates(out)


def _overview_rates(totals: DataFrame) -> DataFrame:
    return totals.withColumn(
        "challenge_rate_pct", Q.rate("total_challenges", "total_requests")
    ).withColumn("block_rate_pct", Q.rate("total_blocks", "total_requests"))


def bot_overview_of(counters: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """The overview from ``continuous.window_counters`` of the bot tables."""
    names = {
        "request_count": "total_requests",
        "challenge_count": "total_challenges",
        "block_count": "total_blocks",
        "allow_count": "total_allows",
    }
    return _overview_rates(Q.per_tenant(counters, [F.sum(c).alias(n) for c, n in names.items()], tenants))


def bot_sparkline(
    events: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    lbs: DataFrame | None = None,
    per_lb: bool = False,
) -> DataFrame:
    rows = Q.windowed(events, as_of, lbs, hours=hours)
    return Q.sparkline(rows, POINT_COUNTERS, by=Q.LB_KEYS if per_lb else None)


def bot_topk(
    events: DataFrame,
    dim: str,
    *,
    as_of: AsOf,
    hours: int = 24,
    action: str | None = None,
    bot_category: str | None = None,
    lbs: DataFrame | None = None,
    k: int = settings.TOP_K,
) -> DataFrame:
    if dim not in TOPK_DIMS:
        raise ValueError(f"unknown dimension {dim}")
    where: Column = F.lit(True)
    if action:
        where &= F.col("action") == action.upper()
    if bot_category:
        where &= F.col("bot_category") == bot_category.lower()
    return Q.count_topk(Q.windowed(events, as_of, lbs, hours=hours), dim, k, where=where)


def recent_bot_events(
    events: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    action: str | None = None,
    source: str | None = None,
    bot_category: str | None = None,
    lbs: DataFrame | None = None,
    limit: int = 200,
) -> DataFrame:
    """Newest events of each tenant."""
    rows = Q.windowed(events, as_of, lbs, hours=hours)
    if action:
        rows = rows.filter(F.col("action") == action.upper())
    if source:
        rows = rows.filter(F.col("source") == source.lower())
    if bot_category:
        rows = rows.filter(F.col("bot_category") == bot_category.lower())
    cols = [
        "tenant_id",
        "id",
        "event_time",
        "lb_namespace",
        "lb_name",
        "source",
        "action",
        "bot_category",
        "confidence_bucket",
        "confidence_score",
        "challenge_result",
        "challenge_type",
        "source_ip",
        "source_country",
        "source_asn",
        "method",
        "endpoint_path",
        "ua_family",
        "user_agent",
        "device_anomalies",
    ]
    return top_per_group(
        rows.select(*[c for c in cols if c in rows.columns]),
        Q.TENANT,
        [F.desc("event_time"), F.asc("id")],
        limit,
    )


def bot_endpoint_breakdown(
    events: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    lbs: DataFrame | None = None,
    limit: int = settings.ENDPOINT_BREAKDOWN_LIMIT,
) -> DataFrame:
    """Per (path, method): counts, distinct addresses, last seen, commonest category.

    Each event counts once for its address and once for its category. The first
    shuffle is on (endpoint, kind, value), so a hot endpoint is spread over its
    addresses, and the second sees one partial row per endpoint and task.
    """
    rows = Q.windowed(events, as_of, lbs, hours=hours).filter(F.col("endpoint_path").isNotNull())
    kinds = F.array(
        F.struct(F.lit("ip").alias("kind"), F.col("source_ip").alias("value")),
        F.struct(F.lit("category").alias("kind"), F.col("bot_category").alias("value")),
    )
    names = {
        "CHALLENGE": "challenge_count",
        "BLOCK": "block_count",
        "ALLOW": "allow_count",
        "MONITOR": "monitor_count",
    }
    key = ["tenant_id", "endpoint_path", "method"]
    by_value = (
        rows.select(*key, "action", "event_time", F.inline(kinds))
        .groupBy(*key, "kind", "value")
        .agg(F.count("*").alias("n"), *Q.action_counts(names), F.max("event_time").alias("last"))
    )
    ip, category = F.col("kind") == "ip", F.col("kind") == "category"
    stats = by_value.groupBy(*key).agg(
        F.sum(F.when(ip, F.col("n"))).alias("total_events"),
        *[F.sum(F.when(ip, F.col(n))).alias(n) for n in names.values()],
        F.count_if(ip & F.col("value").isNotNull()).alias("distinct_source_ips"),
        F.max("last").alias("last_seen_at"),
        commonest(F.when(category, F.col("value")), F.col("n")).alias("top_bot_category"),
    )
    order = [F.desc("total_events"), F.asc("endpoint_path"), F.asc_nulls_first("method")]
    return top_per_group(stats, Q.TENANT, order, limit)


def bot_interventions(points: DataFrame) -> DataFrame:
    """Chart column of the bot series."""
    return points.withColumn("interventions", F.col("challenge_count") + F.col("block_count"))
