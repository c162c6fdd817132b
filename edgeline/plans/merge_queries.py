"""Merges, reaping and retention: end states of a target table and a batch.

The target is what was stored before a moment, the batch is a re-pull of
everything with renewed values, so every row takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.operators import merge, retention
from edgeline.plans.alert_queries import order_alerts
from edgeline.plans.config_queries import load_balancers
from edgeline.plans.event_queries import SECURITY_VIEWS, SIGNALS
from edgeline.plans.registry import query

MID = "TIMESTAMP '2024-01-16 00:00:00'"


def mid():
    return F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")


@query(
    "insert_if_absent",
    f"""SELECT id, event_time, tenant_id, lb_namespace, lb_name, CASE WHEN event_time < {MID} THEN 'stored' ELSE 'first' END AS origin
FROM waf_events""",
    ["waf_events"],
)
def _(v):
    rows = v.waf_events.select("id", "event_time", "tenant_id", "lb_namespace", "lb_name")
    target = rows.filter(F.col("event_time") < mid()).withColumn("origin", F.lit("stored"))
    # every event is pulled twice; the copy with the lower sequence number comes first
    copies = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("first").alias("origin")),
        F.struct(F.lit(2).alias("seq"), F.lit("second").alias("origin")),
    )
    batch = rows.select("*", F.inline(copies))
    new = merge.new_rows(target, batch, merge.EVENT_KEYS, F.col("seq")).drop("seq")
    return target.unionByName(new)


@query(
    "upsert_overwrite",
    """SELECT bucket_time, tenant_id, lb_namespace, lb_name, request_count + 1 AS request_count, blocked_count,
  monitored_count, error_count FROM waf_metrics""",
    ["waf_metrics"],
)
def _(v):
    metrics = v.waf_metrics
    target = metrics.filter(F.col("bucket_time") < mid()).withColumn("seq", F.lit(0))
    older = metrics.withColumn("request_count", F.lit(0).cast("bigint")).withColumn("seq", F.lit(1))
    newer = metrics.withColumn("request_count", F.col("request_count") + 1).withColumn(
        "seq", F.lit(2)
    )
    batch = older.unionByName(newer)
    return merge.upsert_overwrite(target, batch, merge.METRIC_KEYS, F.col("seq")).drop("seq")


SYNC = "2024-02-01 00:00:00"


def sync():
    return F.lit(SYNC).cast("timestamp_ntz")


def stored_certificates(v):
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return v.certificates.withColumn("last_seen_at", seen)


@query(
    "snapshot_upsert",
    f"""SELECT tenant_id, namespace, name, CASE WHEN not_after IS NULL THEN subject ELSE 'renewed' END AS subject, not_after,
  CASE WHEN not_after IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '{SYNC}' END AS last_seen_at FROM certificates""",
    ["certificates"],
)
def _(v):
    batch = v.certificates.filter("not_after IS NOT NULL").withColumn("subject", F.lit("renewed"))
    return merge.snapshot_upsert(
        stored_certificates(v), batch, merge.OBJECT_KEYS, sync(), F.col("subject")
    )


@query(
    "reap_stale",
    """SELECT tenant_id, namespace, name FROM certificates WHERE not_after IS NOT NULL OR namespace IN ('ns1', 'ns3')""",
    ["certificates"],
)
def _(v):
    batch = v.certificates.filter("not_after IS NOT NULL")
    after = merge.snapshot_upsert(
        stored_certificates(v), batch, merge.OBJECT_KEYS, sync(), F.col("subject")
    )
    listings = v.certificates.select(
        "tenant_id", "namespace", F.col("namespace").isin("ns0", "ns2").alias("ok")
    )
    scope = ["tenant_id", "namespace"]
    ok = merge.scopes_with_success(listings, scope)
    return merge.reap_stale(after, sync(), ok, scope).select("tenant_id", "namespace", "name")


@query(
    "reap_stale_per_parent",
    """SELECT tenant_id, lb_namespace, lb_name, method, endpoint_path FROM api_endpoints e
WHERE last_seen_at >= (SELECT t FROM now_) - INTERVAL '6 hours' OR NOT EXISTS (SELECT 1 FROM event_lbs l WHERE l.has_waf
  AND l.tenant_id = e.tenant_id AND l.namespace = e.lb_namespace AND l.name = e.lb_name)""",
    ["api_endpoints", "event_lbs", "now_"],
)
def _(v):
    refreshed = v.event_lbs.filter("has_waf").select(
        "tenant_id", F.col("namespace").alias("lb_namespace"), F.col("name").alias("lb_name")
    )
    since = v.as_of - F.expr("INTERVAL 6 HOURS")
    kept = merge.reap_stale_per_parent(v.endpoint_stats, refreshed, since, "last_seen_at")
    return kept.select("tenant_id", "lb_namespace", "lb_name", "method", "endpoint_path")


@query(
    "cascade_delete",
    """SELECT tenant_id, pool_id, origin_address, origin_port, site_name FROM origin_health h
WHERE EXISTS (SELECT 1 FROM origin_pools p WHERE p.port = 443 AND p.tenant_id = h.tenant_id AND p.pool_id = h.pool_id)""",
    ["origin_health", "origin_pools"],
)
def _(v):
    survivors = v.origin_pools.filter("port = 443")
    on = {"tenant_id": "tenant_id", "pool_id": "pool_id"}
    kept = merge.cascade_delete(v.origin_health, survivors, on)
    return kept.select("tenant_id", "pool_id", "origin_address", "origin_port", "site_name")


NEW_WEEK = SIGNALS.format(h=168)
# the older profiles: the same correlation as of a week before the end
OLD_WEEK = (
    SIGNALS.replace("(SELECT t FROM now_)", "((SELECT t FROM now_) - INTERVAL '168 hours')")
    .format(h=168)
    .replace("w AS (", "w0 AS (", 1)
)
for _t in ("b", "sig", "att", "te", "ts", "profiles"):
    OLD_WEEK = OLD_WEEK.replace(f"\n{_t} AS (", f"\n{_t}0 AS (")
OLD_WEEK = (
    OLD_WEEK.replace("FROM w\n", "FROM w0\n")
    .replace("FROM b)", "FROM b0)")
    .replace("FROM sig ", "FROM sig0 ")
    .replace("FROM att LEFT JOIN te ON", "FROM att0 att LEFT JOIN te0 te ON")
    .replace("LEFT JOIN ts ON", "LEFT JOIN ts0 ts ON")
)


@query(
    "attacker_profile_merge",
    f"""WITH {NEW_WEEK}, {OLD_WEEK},
k AS (SELECT tenant_id, source_ip, source_asn, source_country FROM profiles
  UNION SELECT tenant_id, source_ip, source_asn, source_country FROM profiles0)
SELECT k.*, CASE WHEN n.source_ip IS NULL THEN o.total_events ELSE n.total_events END AS total_events,
  CASE WHEN n.source_ip IS NULL THEN o.waf_block_count ELSE n.waf_block_count END AS waf_block_count,
  CASE WHEN n.source_ip IS NULL THEN o.top_endpoint ELSE n.top_endpoint END AS top_endpoint,
  CASE WHEN n.source_ip IS NULL THEN o.top_signature ELSE n.top_signature END AS top_signature,
  CASE WHEN n.source_ip IS NULL THEN o.distinct_lbs ELSE n.distinct_lbs END AS distinct_lbs,
  least(n.first_seen_at, o.first_seen_at) AS first_seen_at, greatest(n.last_seen_at, o.last_seen_at) AS last_seen_at
FROM k LEFT JOIN profiles n ON n.tenant_id = k.tenant_id AND n.source_ip = k.source_ip
    AND n.source_asn IS NOT DISTINCT FROM k.source_asn AND n.source_country IS NOT DISTINCT FROM k.source_country
  LEFT JOIN profiles0 o ON o.tenant_id = k.tenant_id AND o.source_ip = k.source_ip
    AND o.source_asn IS NOT DISTINCT FROM k.source_asn AND o.source_country IS NOT DISTINCT FROM k.source_country""",
    SECURITY_VIEWS,
)
def _(v):
    from datetime import timedelta

    from edgeline.operators.security import attacker_correlation

    week = timedelta(hours=168)
    before = v.as_of - F.expr("INTERVAL 168 HOURS")
    old = attacker_correlation(v.waf_events, v.bot_events, as_of=before, window=week)
    new = attacker_correlation(v.waf_events, v.bot_events, as_of=v.as_of, window=week)
    return merge.attacker_profile_merge(old, new).select(
        *merge.PROFILE_KEYS,
        "total_events",
        "waf_block_count",
        "top_endpoint",
        "top_signature",
        "distinct_lbs",
        "first_seen_at",
        "last_seen_at",
    )


# --- retention ---------------------------------------------------------------------


@query(
    "retention",
    "SELECT id, event_time FROM waf_events WHERE event_time >= (SELECT t FROM now_) - INTERVAL '7 days'",
    ["waf_events", "now_"],
)
def _(v):
    return retention.retention(v.waf_events, "event_time", 7, v.as_of).select("id", "event_time")


RESOLVED_AT = "o_orderdate + INTERVAL '10 days'"


@query(
    "resolved_alert_retention",
    f"""SELECT 'key:' || o_orderkey AS dedupe_key, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'acknowledged'
  ELSE 'resolved' END AS status FROM orders
WHERE NOT (o_orderstatus = 'F' AND {RESOLVED_AT} < TIMESTAMP '1998-06-01' - INTERVAL '90 days')""",
)
def _(v):
    kept = retention.resolved_alert_retention(order_alerts(v), v.cert_as_of)
    return kept.select("dedupe_key", "status")


@query(
    "audit_retention",
    """SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL '180 days'""",
)
def _(v):
    from edgeline.plans.inventory_queries import audit

    return retention.audit_retention(audit(v), v.cert_as_of).select("id", "created_at")


@query(
    "set_difference",
    """SELECT tenant_id, namespace, name FROM load_balancers WHERE cert_ref IS NULL""",
    ["load_balancers"],
)
def _(v):
    lbs = load_balancers(v)
    with_cert = lbs.filter("cert_ref IS NOT NULL")
    return lbs.join(with_cert, merge.OBJECT_KEYS, "left_anti").select(*merge.OBJECT_KEYS)
