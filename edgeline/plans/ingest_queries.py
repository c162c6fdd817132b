"""Ingestion of raw events, metric documents and API discovery records."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.plans import payloads as P
from edgeline.plans.registry import query
from edgeline.plans.scalar_queries import DASHED, HEX
from edgeline.sources import apis, events, metrics

READABLE = "event_id % 97 <> 0"


def event_id(parts: str) -> str:
    return f"""CASE WHEN event_id % 2 = 0 THEN {DASHED.format(h=HEX)}
    ELSE {DASHED.format(h=f"sha1({parts})")} END AS id"""


TIME_TEXT = "strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ')"
# odd ids: the time and the path sit under other names, so they are empty in the digest
WAF_ID = event_id("'|' || '|' || '|' || method || '|' || 'vh-' || (k % 10)")


@query(
    "waf_events_from_raw",
    f"""SELECT event_time, {WAF_ID}, tenant_id, lb_namespace, lb_name, action, source_ip, source_country, source_asn,
  method, url, CAST(NULL AS VARCHAR) AS user_agent, response_code, primary_signature,
  CASE WHEN k % 3 = 0 THEN '["V' || (k % 5) || '"]' END AS signature_ids, CAST(NULL AS VARCHAR) AS threat_categories,
  severity,
  CASE event_id % 4 WHEN 0 THEN 'shared' WHEN 1 THEN lb_namespace END AS waf_policy_namespace,
  CASE event_id % 4 WHEN 0 THEN 'fw-' || (k % 3) WHEN 1 THEN primary_signature END AS waf_policy_name
FROM waf_events WHERE {READABLE}""",
    ["waf_events"],
)
def _(v):
    return events.waf_events_from_raw(P.security_records(v)).drop("raw_event")


@query(
    "waf_events_without_bots",
    f"""SELECT event_time, tenant_id, lb_name, action FROM (SELECT *, CASE k % 8 WHEN 0 THEN 'BLOCK'
  WHEN 2 THEN 'JS_CHALLENGE' WHEN 4 THEN 'MONITOR' ELSE 'ALLOW' END AS action FROM (SELECT * EXCLUDE (action)
  FROM bot_events)) WHERE {READABLE} AND event_id % 3 = 2""",
    ["bot_events"],
)
def _(v):
    out = events.waf_events_from_raw(P.standard_bot_records(v), exclude_bot=True)
    return out.select("event_time", "tenant_id", "lb_name", "action")


@query(
    "bot_filter",
    f"SELECT event_id, tenant_id, lb_namespace, lb_name FROM bot_events WHERE {READABLE} AND event_id % 3 <> 2",
    ["bot_events"],
)
def _(v):
    return events.bot_filter(P.standard_bot_records(v)).drop("payload")


UA = """CASE k % 13 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)'
  WHEN 2 THEN 'DuckDuckBot/1.1' WHEN 3 THEN 'curl/8.4.0' WHEN 4 THEN 'Wget/1.21' WHEN 5 THEN 'python-requests/2.31'
  WHEN 6 THEN 'okhttp/4.9' WHEN 7 THEN 'PostmanRuntime/7.36' WHEN 8 THEN 'Mozilla/5.0 HeadlessChrome/120'
  WHEN 9 THEN 'Mozilla/5.0 (X11) Chrome/120.0 Safari/537.36' WHEN 10 THEN 'Mozilla/5.0 (X11) Firefox/121.0'
  WHEN 11 THEN 'Mozilla/5.0 (Mac) Safari/605 Version/17' ELSE 'CustomAgent/1.0' END AS user_agent"""
BOT_ID = event_id(
    f"{TIME_TEXT} || '|' || coalesce(source_ip, '') || '|' || endpoint_path || '|' || method || '|'"
)
ADV_ID = event_id("'|' || '|' || '|' || method || '|'")


@query(
    "bot_events_standard",
    f"""SELECT event_time, {BOT_ID}, tenant_id, lb_namespace, lb_name, 'standard' AS source, action, bot_category,
  confidence_bucket, confidence_score,
  CASE WHEN action <> 'CHALLENGE' THEN 'not_issued' WHEN event_id % 3 = 1 AND k % 3 = 0 THEN 'failed'
    WHEN event_id % 3 = 1 AND k % 3 = 1 THEN 'passed' ELSE 'abandoned' END AS challenge_result,
  CASE WHEN action = 'CHALLENGE' AND event_id % 3 = 1 THEN 'js' END AS challenge_type,
  CAST(NULL AS VARCHAR) AS device_anomalies, source_ip, source_country, source_asn, method, endpoint_path, {UA},
  ua_family, CASE WHEN event_id % 3 = 1 THEN 'shared' ELSE lb_namespace END AS bot_policy_namespace,
  CASE WHEN event_id % 3 = 1 THEN 'bp-' || (k % 4) ELSE 'Bot Defense Violation' END AS bot_policy_name
FROM bot_events WHERE {READABLE} AND event_id % 3 <> 2""",
    ["bot_events"],
)
def _(v):
    return events.bot_events_standard(P.standard_bot_records(v)).drop("raw_event")


# a numeric score of 0 in the first field falls through to the second, which is absent here
ADVANCED = f"""SELECT event_time, {ADV_ID}, tenant_id, lb_namespace, lb_name, 'bd_advanced' AS source, action,
  bot_category, CASE WHEN event_id % 2 = 0 AND confidence_score = 0 THEN 'unknown' ELSE confidence_bucket END
    AS confidence_bucket,
  CASE WHEN event_id % 2 = 1 OR confidence_score <> 0 THEN confidence_score END AS confidence_score,
  CASE WHEN k % 3 = 0 THEN 'failed' WHEN k % 3 = 1 THEN 'passed' WHEN event_id % 2 = 1 THEN 'not_issued'
    WHEN action = 'CHALLENGE' THEN 'abandoned' ELSE 'not_issued' END AS challenge_result,
  CASE WHEN event_id % 2 = 0 THEN 'js' ELSE 'captcha' END AS challenge_type,
  CASE WHEN event_id % 2 = 0 THEN 'a' || (k % 3) || ',b' END AS device_anomalies, source_ip, source_country, source_asn,
  method, endpoint_path, {UA}, ua_family,
  CASE WHEN event_id % 2 = 0 THEN 'shared' END AS bot_policy_namespace,
  CASE WHEN event_id % 2 = 0 THEN 'bp-' || (k % 4) END AS bot_policy_name
FROM bot_events WHERE {READABLE}"""


@query("bot_events_advanced", ADVANCED, ["bot_events"])
def _(v):
    return events.bot_events_advanced(P.advanced_bot_records(v)).drop("raw_event")


@query(
    "bot_events_both_feeds",
    f"""SELECT source, bot_category, count(*) AS n FROM (SELECT 'standard' AS source, bot_category FROM bot_events
  WHERE {READABLE} AND event_id % 3 <> 2 UNION ALL SELECT 'bd_advanced', bot_category FROM bot_events WHERE {READABLE})
GROUP BY ALL""",
    ["bot_events"],
)
def _(v):
    rows = events.bot_events(P.standard_bot_records(v), P.advanced_bot_records(v))
    return rows.groupBy("source", "bot_category").agg(F.count("*").alias("n"))


@query(
    "protected_lb_scope",
    """SELECT event_id, tenant_id, lb_namespace, lb_name FROM waf_events e WHERE EXISTS (SELECT 1 FROM event_lbs l
  WHERE has_waf AND l.tenant_id = e.tenant_id AND l.namespace = e.lb_namespace AND l.name = e.lb_name)""",
    ["waf_events", "event_lbs"],
)
def _(v):
    return events.protected_lb_scope(P.security_records(v), v.event_lbs, "has_waf").drop("payload")


@query("waf_metric_buckets", "SELECT * FROM waf_metrics", ["waf_metrics"])
def _(v):
    return metrics.waf_metric_buckets(P.waf_metric_documents(v)).drop("landed_at")


@query(
    "waf_metric_corrections",
    """SELECT bucket_time, tenant_id, lb_namespace, lb_name, request_count, TIMESTAMP '2024-03-01 00:09:00' AS landed_at
FROM waf_metrics""",
    ["waf_metrics"],
)
def _(v):
    out = metrics.waf_metric_buckets(P.corrected_waf_documents(v))
    return out.select("bucket_time", *P.KEYS, "request_count", "landed_at")


@query(
    "waf_events_long_paths",
    """SELECT event_time, tenant_id, url, length(url) AS n, md5(raw_event) AS raw_md5 FROM (
  SELECT event_time, tenant_id, '/' || repeat('x', 3000) || url AS url,
    '{"time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ') || '","method":"' || method || '","url":"/' || repeat('x', 3000)
      || url || '"}' AS raw_event FROM waf_events)""",
    ["waf_events"],
)
def _(v):
    out = events.waf_events_from_raw(P.long_path_records(v))
    return out.select("event_time", "tenant_id", "url", F.length("url").cast("bigint").alias("n"), F.md5(F.col("raw_event").cast("binary")).alias("raw_md5"))


@query(
    "bot_metric_buckets",
    """SELECT m.* FROM bot_metrics m JOIN event_lbs l ON l.tenant_id = m.tenant_id AND l.namespace = m.lb_namespace
  AND l.name = m.lb_name WHERE l.has_bot_defense""",
    ["bot_metrics", "event_lbs"],
)
def _(v):
    return metrics.bot_metric_buckets(P.bot_metric_documents(v), v.event_lbs).drop("landed_at")


@query("api_metric_buckets", "SELECT * FROM api_metrics", ["api_metrics"])
def _(v):
    return metrics.api_metric_buckets(P.api_metric_documents(v)).drop("landed_at")


# a numeric confidence of 0 falls through to the second field, which is absent for odd paths
@query(
    "api_endpoint_inventory",
    """SELECT tenant_id, lb_namespace, lb_name, method, endpoint_path,
  CASE WHEN NOT is_shadow THEN 'shared' END AS api_definition_namespace,
  CASE WHEN NOT is_shadow THEN 'def-x' END AS api_definition_name,
  CASE WHEN length(endpoint_path) % 2 = 0 OR total_request_samples % 101 <> 0
    THEN CAST(total_request_samples % 101 AS INTEGER) END AS discovery_confidence,
  CASE WHEN length(endpoint_path) % 2 = 1 THEN total_request_samples ELSE 0 END AS total_request_samples,
  last_seen_at, first_seen_at,
  CASE WHEN length(endpoint_path) % 2 = 1 THEN array_to_string(response_codes, ',') END AS response_codes,
  CASE WHEN length(endpoint_path) % 2 = 1 THEN '[{"name":"id"}]' END AS query_params,
  CAST(NULL AS VARCHAR) AS body_params, auth_type, is_shadow FROM api_endpoints""",
    ["api_endpoints"],
)
def _(v):
    return apis.api_endpoint_inventory(
        P.endpoint_records(v), v.event_attachments, v.api_definitions
    )


@query(
    "api_discovery_state",
    """SELECT tenant_id, lb_namespace, lb_name, state, confidence_score,
  CASE WHEN total_traffic_samples % 2 = 1 THEN total_endpoints_discovered ELSE 0 END AS total_endpoints_discovered,
  total_traffic_samples, TIMESTAMP '2024-01-01' AS last_learning_update, state_changed_at FROM states""",
    ["states"],
)
def _(v):
    return apis.api_discovery_state(P.state_records(v))
