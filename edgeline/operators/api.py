"""API inventory and per-endpoint metric queries, for all tenants in one job."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions import paging
from edgeline.functions.paging import Cursor
from edgeline.functions.ranking import top_per_group
from edgeline.functions.timewin import AsOf, bucket, percent, round_half_up, within
from edgeline.operators import series as Q

ENDPOINT = ["lb_namespace", "lb_name", "method", "endpoint_path"]
MIN_REQUESTS_FOR_RATE = 100


def _recent(metrics: DataFrame, as_of: AsOf, lbs: DataFrame | None = None, **back) -> DataFrame:
    rows = within(metrics, "bucket_time", as_of, timedelta(**back))
    return Q.lb_filter(rows, lbs) if lbs is not None else rows


def api_overview(
    endpoints: DataFrame, states: DataFrame, metrics: DataFrame, *, as_of: AsOf, minutes: int = 60
) -> DataFrame:
    """Inventory totals, endpoints per learning state, mean p99 and error share."""
    traffic = _recent(metrics, as_of, minutes=minutes).groupBy("tenant_id").agg(
        F.avg("latency_p99_ms").alias("p99"),
        F.sum("request_count").alias("req"),
        F.sum(F.col("error_4xx_count") + F.col("error_5xx_count")).alias("err"),
    )
    return _overview(endpoints, states, traffic)


def api_overview_of(endpoints: DataFrame, states: DataFrame, traffic: DataFrame) -> DataFrame:
    """The overview from ``continuous.window_traffic``."""
    traffic = traffic.groupBy("tenant_id").agg(
        (F.sum("latency_p99_sum") / F.sum("latency_p99_minutes")).alias("p99"),
        F.sum("request_count").alias("req"),
        F.sum("error_count").alias("err"),
    )
    return _overview(endpoints, states, traffic)


def _overview(endpoints: DataFrame, states: DataFrame, traffic: DataFrame) -> DataFrame:
    inventory = endpoints.groupBy("tenant_id").agg(
        F.count("*").alias("total_endpoints"),
        F.count_if("is_shadow").alias("shadow_endpoints"),
        F.count_if(~F.col("is_shadow")).alias("declared_endpoints"),
    )
    # five known states, so the map of one tenant stays tiny
    per_state = states.groupBy("tenant_id", "state").agg(F.count("*").alias("n"))
    state_counts = per_state.groupBy("tenant_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias(
            "state_counts"
        )
    )
    joined = inventory.join(state_counts, "tenant_id", "full_outer").join(
        traffic, "tenant_id", "full_outer"
    )
    zero = ["total_endpoints", "shadow_endpoints", "declared_endpoints", "req", "err"]
    return joined.fillna(0, zero).select(
        "tenant_id",
        *zero[:3],
        F.coalesce("state_counts", F.create_map().cast("map<string,bigint>")).alias("state_counts"),
        round_half_up(F.col("p99"), 1).alias("avg_p99_latency_ms"),
        percent(F.col("err"), F.col("req")).alias("error_rate_pct"),
    )


def api_endpoint_sparkline(
    metrics: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    endpoints: DataFrame | None = None,
) -> DataFrame:
    """Five-minute series per endpoint; ``endpoints`` narrows it to the given ones."""
    rows = _recent(metrics, as_of, hours=hours)
    key = ["tenant_id", *ENDPOINT]
    if endpoints is not None:
        rows = rows.join(endpoints.select(*key), key, "left_semi")
    points = rows.groupBy(*key, bucket("bucket_time").alias("b5")).agg(
        F.sum("request_count").alias("request_count"),
        F.sum("error_4xx_count").alias("error_4xx_count"),
        F.sum("error_5xx_count").alias("error_5xx_count"),
        round_half_up(F.avg("latency_p50_ms"), 1).alias("latency_p50_ms"),
        round_half_up(F.max("latency_p95_ms"), 1).alias("latency_p95_ms"),
        round_half_up(F.max("latency_p99_ms"), 1).alias("latency_p99_ms"),
    )
    return points.withColumnRenamed("b5", "bucket_time")


def api_sparkline_totals(points: DataFrame) -> DataFrame:
    return points.groupBy("tenant_id", *ENDPOINT).agg(
        F.sum("request_count").alias("total_requests"),
        F.sum("error_4xx_count").alias("total_4xx"),
        F.sum("error_5xx_count").alias("total_5xx"),
        F.max("latency_p99_ms").alias("max_p99_ms"),
    )


def api_errors(points: DataFrame) -> DataFrame:
    """Chart column of the API series."""
    return points.withColumn("errors", F.col("error_4xx_count") + F.col("error_5xx_count"))


def _by_endpoint(rows: DataFrame, value: Column, k: int, keep: Column | None = None) -> DataFrame:
    grouped = rows.groupBy("tenant_id", "method", "endpoint_path").agg(
        value.alias("v"), F.sum("request_count").alias("req")
    )
    if keep is not None:
        grouped = grouped.filter(keep)
    keyed = grouped.select("tenant_id", F.concat_ws(" ", "method", "endpoint_path").alias("key"), "v")
    top = top_per_group(keyed, Q.TENANT, [F.desc("v"), F.asc("key")], k)
    return top.select("tenant_id", "key", F.col("v").cast("bigint").alias("count"))


def api_topk_volume(
    metrics: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    lbs: DataFrame | None = None,
    k: int = settings.TOP_K,
) -> DataFrame:
    return _by_endpoint(_recent(metrics, as_of, lbs, hours=hours), F.sum("request_count"), k)


def api_topk_latency_p99(
    metrics: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    lbs: DataFrame | None = None,
    k: int = settings.TOP_K,
) -> DataFrame:
    """Largest p99; ranked on the exact value, reported in whole milliseconds."""
    rows = _recent(metrics, as_of, lbs, hours=hours).filter(F.col("latency_p99_ms").isNotNull())
    return _by_endpoint(rows, F.max("latency_p99_ms"), k)


def api_topk_error_rate(
    metrics: DataFrame,
    *,
    as_of: AsOf,
    hours: int = 24,
    lbs: DataFrame | None = None,
    k: int = settings.TOP_K,
    min_requests: int = MIN_REQUESTS_FOR_RATE,
) -> DataFrame:
    """Errors per thousand requests of endpoints with enough traffic."""
    per_mille = F.expr(
        "sum(error_4xx_count + error_5xx_count) * 1000 div greatest(sum(request_count), 1)"
    )
    rows = _recent(metrics, as_of, lbs, hours=hours)
    return _by_endpoint(rows, per_mille, k, keep=F.col("req") >= min_requests)


def api_topk_shadow(
    endpoints: DataFrame, *, lbs: DataFrame | None = None, k: int = settings.TOP_K
) -> DataFrame:
    """Shadow endpoints with most samples; every inventory row stands for itself."""
    rows = endpoints.filter("is_shadow")
    if lbs is not None:
        rows = Q.lb_filter(rows, lbs)
    keyed = rows.select(
        "tenant_id",
        F.concat_ws(" ", "method", "endpoint_path").alias("key"),
        F.col("total_request_samples").alias("count"),
        "lb_namespace",
        "lb_name",
    )
    order = [F.desc("count"), F.asc("key"), F.asc("lb_namespace"), F.asc("lb_name")]
    return top_per_group(keyed, Q.TENANT, order, k).select("tenant_id", "key", "count")


def api_topk_inventory(
    endpoints: DataFrame, dim: str, *, lbs: DataFrame | None = None, k: int = settings.TOP_K
) -> DataFrame:
    """Endpoints per HTTP method or authentication type."""
    if dim not in ("method", "auth_type"):
        raise ValueError(f"unknown dimension {dim}")
    rows = Q.lb_filter(endpoints, lbs) if lbs is not None else endpoints
    return Q.count_topk(rows, dim, k)


def endpoint_keys(sort: str) -> list[paging.Key]:
    first = {
        "volume": [paging.Key("total_request_samples", descending=True)],
        "last_seen": [paging.Key("last_seen_at", descending=True)],
        "method": [paging.Key("method")],
        "path": [],
    }[sort]
    unique = [paging.Key(c) for c in ("endpoint_path", "method", "lb_namespace", "lb_name")]
    return first + [k for k in unique if k not in first]


def api_endpoint_list(
    endpoints: DataFrame,
    *,
    shadow_only: bool = False,
    lbs: DataFrame | None = None,
    auth_type: str | None = None,
    sort: str = "volume",
    limit: int = 100,
    offset: int = 0,
    after: Cursor = None,
) -> DataFrame:
    """One page of the inventory per tenant, behind an offset or a cursor of ``endpoint_keys``; nulls come first."""
    rows = endpoints.filter("is_shadow") if shadow_only else endpoints
    if lbs is not None:
        rows = Q.lb_filter(rows, lbs)
    if auth_type:
        rows = rows.filter(F.col("auth_type") == auth_type.lower())
    return paging.page(rows, Q.TENANT, endpoint_keys(sort), limit, offset=offset, at=after)


def discovery_state_list(states: DataFrame) -> DataFrame:
    return states.orderBy("tenant_id", "lb_name", "lb_namespace")


def lb_api_card(endpoints: DataFrame, states: DataFrame) -> DataFrame:
    """Endpoints, shadow endpoints and learning state per load balancer."""
    counts = endpoints.groupBy(*Q.LB_KEYS).agg(
        F.count("*").alias("endpoints_discovered"), F.count_if("is_shadow").alias("shadow_count")
    )
    state = states.select(*Q.LB_KEYS, "state", "confidence_score", "total_traffic_samples")
    return counts.join(state, Q.LB_KEYS, "full_outer").fillna(
        0, ["endpoints_discovered", "shadow_count"]
    )
