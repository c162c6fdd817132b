"""Queries over firewall, bot and API events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from edgeline.functions import paging
from edgeline.operators import api, bot, inventory, rollups, security, series, sketches, waf
from edgeline.plans.ctes import pct, rnd
from edgeline.plans.registry import query

WEEK = 168
LAST_WEEK = "event_time >= (SELECT s FROM now_) - INTERVAL '168 hours' AND event_time <= (SELECT s FROM now_)"
LAST_DAY = "event_time >= (SELECT s FROM now_) - INTERVAL '24 hours' AND event_time <= (SELECT s FROM now_)"
METRIC_WEEK = LAST_WEEK.replace("event_time", "bucket_time")
# windows of the security queries: exact time, lower bound only
OPEN_WEEK = "event_time >= (SELECT t FROM now_) - INTERVAL '168 hours'"
OPEN_DAY = "event_time >= (SELECT t FROM now_) - INTERVAL '24 hours'"


def count_if(cond: str, name: str) -> str:
    return f"count(*) FILTER ({cond}) AS {name}"


# --- firewall ---------------------------------------------------------------

BLOCKED = count_if("action = 'BLOCK'", "blocked_count")
MONITORED = count_if("action = 'MONITOR'", "monitored_count")
ERRORS = count_if("action = 'ALLOW'", "error_count")
POINT = f"count(*) AS request_count, {BLOCKED}, {MONITORED}, {ERRORS}"
B5 = "time_bucket(INTERVAL '5 minutes', event_time) AS bucket_time"


@query(
    "waf_overview",
    f"""SELECT tenant_id, count(*) AS total_requests, {count_if("action = 'BLOCK'", "total_blocked")},
  {count_if("action = 'MONITOR'", "total_monitored")}, {count_if("action = 'ALLOW'", "total_errors")},
  {count_if("action = 'ALLOW'", "allowed")},
  {pct("count(*) FILTER (action = 'BLOCK')", "count(*)")} AS block_rate_pct
FROM waf_events WHERE {LAST_DAY} GROUP BY tenant_id""",
    ["waf_events", "now_"],
)
def _(v):
    return waf.waf_overview(v.waf_events, as_of=v.as_of, minutes=1440)


@query(
    "waf_overview_idle_tenants",
    f"""SELECT a.tenant_id, coalesce(total_requests, 0) AS total_requests, coalesce(total_blocked, 0) AS total_blocked,
  coalesce(total_monitored, 0) AS total_monitored, coalesce(total_errors, 0) AS total_errors,
  coalesce(total_errors, 0) AS allowed, coalesce(rate, 0.0) AS block_rate_pct
FROM (SELECT DISTINCT tenant_id FROM waf_events) a LEFT JOIN (
  SELECT tenant_id, count(*) AS total_requests, {count_if("action = 'BLOCK'", "total_blocked")},
  {count_if("action = 'MONITOR'", "total_monitored")}, {count_if("action = 'ALLOW'", "total_errors")},
  {pct("count(*) FILTER (action = 'BLOCK')", "count(*)")} AS rate
  FROM waf_events WHERE event_time >= (SELECT s FROM now_) - INTERVAL '1 minute'
    AND event_time <= (SELECT s FROM now_) GROUP BY tenant_id) b USING (tenant_id)""",
    ["waf_events", "now_"],
)
def _(v):
    return waf.waf_overview(v.waf_events, as_of=v.as_of, minutes=1, tenants=v.tenant_ids)


@query(
    "waf_sparkline",
    f"SELECT tenant_id, {B5}, {POINT} FROM waf_events WHERE {LAST_WEEK} GROUP BY ALL",
    ["waf_events", "now_"],
)
def _(v):
    return waf.waf_sparkline(v.waf_events, as_of=v.as_of, hours=WEEK)


@query(
    "waf_sparkline_totals",
    f"""SELECT tenant_id, count(*) AS points, CAST(sum(request_count) AS BIGINT) AS total_request_count,
  CAST(sum(blocked_count) AS BIGINT) AS total_blocked_count,
  CAST(sum(monitored_count) AS BIGINT) AS total_monitored_count,
  CAST(sum(error_count) AS BIGINT) AS total_error_count
FROM (SELECT tenant_id, {B5}, {POINT} FROM waf_events WHERE {LAST_WEEK} GROUP BY ALL) GROUP BY tenant_id""",
    ["waf_events", "now_"],
)
def _(v):
    return series.sparkline_totals(waf.waf_sparkline(v.waf_events, as_of=v.as_of, hours=WEEK))


@query(
    "waf_sparkline_per_lb",
    f"SELECT tenant_id, lb_namespace, lb_name, {B5}, {POINT} FROM waf_events WHERE {LAST_WEEK} GROUP BY ALL",
    ["waf_events", "now_"],
)
def _(v):
    return waf.waf_sparkline(v.waf_events, as_of=v.as_of, hours=WEEK, per_lb=True)


@query(
    "lb_filter",
    f"""SELECT tenant_id, {B5}, {POINT} FROM waf_events e WHERE {LAST_WEEK}
  AND EXISTS (SELECT 1 FROM event_lbs l WHERE l.has_bot_defense AND l.tenant_id = e.tenant_id
    AND l.namespace = e.lb_namespace AND l.name = e.lb_name) GROUP BY ALL""",
    ["waf_events", "now_", "event_lbs"],
)
def _(v):
    lbs = v.event_lbs.filter("has_bot_defense")
    return waf.waf_sparkline(v.waf_events, as_of=v.as_of, hours=WEEK, lbs=lbs)


def topk_sql(table: str, dim: str, where: str = "true", k: int = 12, window: str = LAST_WEEK) -> str:
    return f"""SELECT tenant_id, key, count FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
    ORDER BY count DESC, key) AS rn FROM (SELECT tenant_id, CAST({dim} AS VARCHAR) AS key, count(*) AS count
      FROM {table} WHERE {window} AND {dim} IS NOT NULL AND {where} GROUP BY tenant_id, {dim})) WHERE rn <= {k}"""


for _dim in waf.TOPK_DIMS:

    @query(f"waf_topk_{_dim}", topk_sql("waf_events", _dim), ["waf_events", "now_"])
    def _(v, dim=_dim):
        return waf.waf_topk(v.waf_events, dim, as_of=v.as_of, hours=WEEK)


@query(
    "waf_topk_blocked_source_ip",
    topk_sql("waf_events", "source_ip", "action = 'BLOCK'"),
    ["waf_events", "now_"],
)
def _(v):
    return waf.waf_topk(v.waf_events, "source_ip", as_of=v.as_of, hours=WEEK, action="block")


@query(
    "recent_waf_events",
    f"""SELECT tenant_id, id, event_time, lb_namespace, lb_name, action, source_ip, source_country, method, url,
  response_code, primary_signature, severity FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
  ORDER BY event_time DESC, id) AS rn FROM waf_events WHERE {LAST_WEEK} AND action = 'BLOCK' AND severity = 'medium')
WHERE rn <= 100""",
    ["waf_events", "now_"],
)
def _(v):
    return waf.recent_waf_events(
        v.waf_events, as_of=v.as_of, hours=WEEK, action="block", severity="Medium", limit=100
    )


@query(
    "recent_waf_events_long",
    f"""SELECT tenant_id, id, event_time, lb_namespace, lb_name, action, source_ip, source_country, method, url,
  response_code, primary_signature, severity FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
  ORDER BY event_time DESC, id) AS rn FROM waf_events WHERE {LAST_WEEK}) WHERE rn <= 2000""",
    ["waf_events", "now_"],
)
def _(v):
    return waf.recent_waf_events(v.waf_events, as_of=v.as_of, hours=WEEK, limit=2000)


@query(
    "firewall_violations",
    f"""SELECT tenant_id, {B5}, {POINT}, count(*) FILTER (action IN ('BLOCK', 'MONITOR')) AS violations
FROM waf_events WHERE {LAST_WEEK} GROUP BY ALL""",
    ["waf_events", "now_"],
)
def _(v):
    return waf.firewall_violations(waf.waf_sparkline(v.waf_events, as_of=v.as_of, hours=WEEK))


@query(
    "policy_traffic",
    f"""SELECT e.tenant_id, policy_namespace, policy_name, {B5}, {POINT} FROM waf_events e
JOIN event_attachments a ON a.tenant_id = e.tenant_id AND a.lb_namespace = e.lb_namespace
  AND a.lb_name = e.lb_name AND policy_type = 'app_firewall'
WHERE {LAST_DAY} GROUP BY ALL""",
    ["waf_events", "now_", "event_attachments"],
)
def _(v):
    return waf.policy_traffic(v.event_attachments, v.waf_events, as_of=v.as_of)


@query(
    "share_of_max",
    f"""SELECT *, CAST({rnd("count::DOUBLE / max(count) OVER (PARTITION BY tenant_id) * 100.0", 0)} AS INTEGER)
  AS pct_of_max FROM ({topk_sql("waf_events", "source_country", "action = 'BLOCK'")})""",
    ["waf_events", "now_"],
)
def _(v):
    top = waf.waf_topk(v.waf_events, "source_country", as_of=v.as_of, hours=WEEK, action="BLOCK")
    return series.share_of_max(top)


@query(
    "donut",
    f"""SELECT tenant_id, key, count, total FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
  ORDER BY count DESC, key) AS rn, CAST(sum(count) OVER (PARTITION BY tenant_id) AS BIGINT) AS total
  FROM ({topk_sql("bot_events", "ua_family")})) WHERE rn <= 5""",
    ["bot_events", "now_"],
)
def _(v):
    return series.donut(bot.bot_topk(v.bot_events, "ua_family", as_of=v.as_of, hours=WEEK))


# --- bots ---------------------------------------------------------------------

CHALLENGED = count_if("action = 'CHALLENGE'", "challenge_count")
BOT_BLOCKED = count_if("action = 'BLOCK'", "block_count")
BOT_ALLOWED = count_if("action = 'ALLOW'", "allow_count")
BOT_POINT = f"count(*) AS request_count, {CHALLENGED}, {BOT_BLOCKED}, {BOT_ALLOWED}"


@query(
    "bot_overview",
    f"""SELECT tenant_id, count(*) AS total_requests, {count_if("action = 'CHALLENGE'", "total_challenges")},
  {count_if("action = 'BLOCK'", "total_blocks")}, {count_if("action = 'ALLOW'", "total_allows")},
  {pct("count(*) FILTER (action = 'CHALLENGE')", "count(*)")} AS challenge_rate_pct,
  {pct("count(*) FILTER (action = 'BLOCK')", "count(*)")} AS block_rate_pct
FROM bot_events WHERE {LAST_DAY} GROUP BY tenant_id""",
    ["bot_events", "now_"],
)
def _(v):
    return bot.bot_overview(v.bot_events, as_of=v.as_of, minutes=1440)


@query(
    "bot_sparkline",
    f"SELECT tenant_id, {B5}, {BOT_POINT} FROM bot_events WHERE {LAST_WEEK} GROUP BY ALL",
    ["bot_events", "now_"],
)
def _(v):
    return bot.bot_sparkline(v.bot_events, as_of=v.as_of, hours=WEEK)


@query(
    "bot_interventions",
    f"""SELECT tenant_id, {B5}, {BOT_POINT}, count(*) FILTER (action IN ('BLOCK', 'CHALLENGE')) AS interventions
FROM bot_events WHERE {LAST_WEEK} GROUP BY ALL""",
    ["bot_events", "now_"],
)
def _(v):
    return bot.bot_interventions(bot.bot_sparkline(v.bot_events, as_of=v.as_of, hours=WEEK))


for _dim in bot.TOPK_DIMS:

    @query(f"bot_topk_{_dim}", topk_sql("bot_events", _dim), ["bot_events", "now_"])
    def _(v, dim=_dim):
        return bot.bot_topk(v.bot_events, dim, as_of=v.as_of, hours=WEEK)


@query(
    "bot_topk_filtered",
    topk_sql("bot_events", "source_ip", "action = 'BLOCK' AND bot_category = 'scraper'"),
    ["bot_events", "now_"],
)
def _(v):
    return bot.bot_topk(
        v.bot_events,
        "source_ip",
        as_of=v.as_of,
        hours=WEEK,
        action="block",
        bot_category="SCRAPER",
    )


@query(
    "recent_bot_events",
    f"""SELECT tenant_id, id, event_time, lb_namespace, lb_name, source, action, bot_category, confidence_bucket,
  confidence_score, challenge_result, challenge_type, source_ip, source_country, source_asn, method, endpoint_path,
  ua_family FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY event_time DESC, id) AS rn
  FROM bot_events WHERE {LAST_WEEK} AND source = 'bd_advanced') WHERE rn <= 200""",
    ["bot_events", "now_"],
)
def _(v):
    rows = bot.recent_bot_events(v.bot_events, as_of=v.as_of, hours=WEEK, source="BD_ADVANCED")
    return rows.drop("user_agent")


@query(
    "bot_endpoint_breakdown",
    f"""WITH w AS (SELECT * FROM bot_events WHERE {LAST_WEEK} AND endpoint_path IS NOT NULL),
s AS (SELECT tenant_id, endpoint_path, method, count(*) AS total_events, {CHALLENGED}, {BOT_BLOCKED}, {BOT_ALLOWED},
  {count_if("action = 'MONITOR'", "monitor_count")}, count(DISTINCT source_ip) AS distinct_source_ips,
  max(event_time) AS last_seen_at FROM w GROUP BY ALL),
c AS (SELECT tenant_id, endpoint_path, method, bot_category AS top_bot_category FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id, endpoint_path, method ORDER BY n DESC, bot_category) AS rn FROM (SELECT tenant_id,
  endpoint_path, method, bot_category, count(*) AS n FROM w GROUP BY ALL)) WHERE rn = 1)
SELECT * EXCLUDE (rn) FROM (SELECT s.*, c.top_bot_category, row_number() OVER (PARTITION BY s.tenant_id
  ORDER BY total_events DESC, s.endpoint_path, s.method) AS rn
FROM s JOIN c USING (tenant_id, endpoint_path, method)) WHERE rn <= 50""",
    ["bot_events", "now_"],
)
def _(v):
    return bot.bot_endpoint_breakdown(v.bot_events, as_of=v.as_of, hours=WEEK)


# --- API ------------------------------------------------------------------------


@query(
    "api_overview",
    f"""SELECT i.tenant_id, total_endpoints, shadow_endpoints, total_endpoints - shadow_endpoints AS declared_endpoints,
  state_counts, {rnd("p99", 1)} AS avg_p99_latency_ms, {pct("err", "req")} AS error_rate_pct
FROM (SELECT tenant_id, count(*) AS total_endpoints, count(*) FILTER (is_shadow) AS shadow_endpoints
      FROM api_endpoints GROUP BY tenant_id) i
LEFT JOIN (SELECT tenant_id, '{{' || string_agg('"' || state || '":' || n, ',' ORDER BY state) || '}}' AS state_counts
  FROM (SELECT tenant_id, state, count(*) AS n FROM states GROUP BY ALL) GROUP BY tenant_id) s USING (tenant_id)
LEFT JOIN (SELECT tenant_id, avg(latency_p99_ms) AS p99, sum(request_count) AS req,
  sum(error_4xx_count + error_5xx_count) AS err FROM api_metrics WHERE {METRIC_WEEK} GROUP BY tenant_id) m
  USING (tenant_id)""",
    ["api_endpoints", "states", "api_metrics", "now_"],
)
def _(v):
    return api.api_overview(
        v.api_endpoints, v.states, v.api_metrics, as_of=v.as_of, minutes=WEEK * 60
    )


API_POINT = f"""SELECT tenant_id, lb_namespace, lb_name, method, endpoint_path,
  time_bucket(INTERVAL '5 minutes', bucket_time) AS bucket_time, CAST(sum(request_count) AS BIGINT) AS request_count,
  CAST(sum(error_4xx_count) AS BIGINT) AS error_4xx_count, CAST(sum(error_5xx_count) AS BIGINT) AS error_5xx_count,
  {rnd("avg(latency_p50_ms)", 1)} AS latency_p50_ms, {rnd("max(latency_p95_ms)", 1)} AS latency_p95_ms,
  {rnd("max(latency_p99_ms)", 1)} AS latency_p99_ms
FROM api_metrics m WHERE {METRIC_WEEK.replace("bucket_time", "m.bucket_time")}"""


@query("api_endpoint_sparkline", API_POINT + " GROUP BY ALL", ["api_metrics", "now_"])
def _(v):
    return api.api_endpoint_sparkline(v.api_metrics, as_of=v.as_of, hours=WEEK)


@query(
    "api_errors_of_shadow_endpoints",
    f"""SELECT *, error_4xx_count + error_5xx_count AS errors FROM ({API_POINT} AND EXISTS (SELECT 1
  FROM api_endpoints e WHERE e.is_shadow AND e.tenant_id = m.tenant_id AND e.lb_namespace = m.lb_namespace
  AND e.lb_name = m.lb_name AND e.method = m.method AND e.endpoint_path = m.endpoint_path) GROUP BY ALL)""",
    ["api_metrics", "now_", "api_endpoints"],
)
def _(v):
    wanted = v.api_endpoints.filter("is_shadow")
    return api.api_errors(
        api.api_endpoint_sparkline(v.api_metrics, as_of=v.as_of, hours=WEEK, endpoints=wanted)
    )


@query(
    "api_sparkline_totals",
    f"""SELECT tenant_id, lb_namespace, lb_name, method, endpoint_path,
  CAST(sum(request_count) AS BIGINT) AS total_requests, CAST(sum(error_4xx_count) AS BIGINT) AS total_4xx,
  CAST(sum(error_5xx_count) AS BIGINT) AS total_5xx, max(latency_p99_ms) AS max_p99_ms
FROM ({API_POINT} GROUP BY ALL) GROUP BY ALL""",
    ["api_metrics", "now_"],
)
def _(v):
    return api.api_sparkline_totals(
        api.api_endpoint_sparkline(v.api_metrics, as_of=v.as_of, hours=WEEK)
    )


def api_top_sql(value: str, where: str = "true", having: str = "true") -> str:
    return f"""SELECT tenant_id, key, CAST(floor(v) AS BIGINT) AS count FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id ORDER BY v DESC, key) AS rn FROM (SELECT tenant_id, method || ' ' || endpoint_path AS key,
    {value} AS v FROM api_metrics WHERE {METRIC_WEEK} AND {where} GROUP BY tenant_id, method, endpoint_path
    HAVING {having})) WHERE rn <= 12"""


@query("api_topk_volume", api_top_sql("sum(request_count)"), ["api_metrics", "now_"])
def _(v):
    return api.api_topk_volume(v.api_metrics, as_of=v.as_of, hours=WEEK)


@query(
    "api_topk_latency_p99",
    api_top_sql("max(latency_p99_ms)", "latency_p99_ms IS NOT NULL"),
    ["api_metrics", "now_"],
)
def _(v):
    return api.api_topk_latency_p99(v.api_metrics, as_of=v.as_of, hours=WEEK)


@query(
    "api_topk_error_rate",
    api_top_sql(
        "sum(error_4xx_count + error_5xx_count) * 1000 // greatest(sum(request_count), 1)",
        having="sum(request_count) >= 20",
    ),
    ["api_metrics", "now_"],
)
def _(v):
    return api.api_topk_error_rate(v.api_metrics, as_of=v.as_of, hours=WEEK, min_requests=20)


@query(
    "api_topk_shadow",
    """SELECT tenant_id, key, count FROM (SELECT tenant_id, method || ' ' || endpoint_path AS key,
  total_request_samples AS count, row_number() OVER (PARTITION BY tenant_id ORDER BY total_request_samples DESC,
  method || ' ' || endpoint_path, lb_namespace, lb_name) AS rn FROM api_endpoints WHERE is_shadow) WHERE rn <= 12""",
    ["api_endpoints"],
)
def _(v):
    return api.api_topk_shadow(v.api_endpoints)


for _dim in ("method", "auth_type"):

    @query(
        f"api_topk_{_dim}", topk_sql("api_endpoints", _dim, window="true"), ["api_endpoints"]
    )
    def _(v, dim=_dim):
        return api.api_topk_inventory(v.api_endpoints, dim)


EP = "tenant_id, lb_namespace, lb_name, method, endpoint_path, total_request_samples, first_seen_at, last_seen_at, array_to_string(response_codes, ',') AS response_codes, auth_type, is_shadow"
EP_ORDER = {
    "volume": "total_request_samples DESC NULLS FIRST, endpoint_path, method, lb_namespace, lb_name",
    "last_seen": "last_seen_at DESC NULLS FIRST, endpoint_path, method, lb_namespace, lb_name",
    "method": "method, endpoint_path, lb_namespace, lb_name",
    "path": "endpoint_path, method, lb_namespace, lb_name",
}
for _sort in EP_ORDER:

    @query(
        f"api_endpoint_list_{_sort}",
        f"""SELECT {EP} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {EP_ORDER[_sort]}) AS rn
FROM api_endpoints) WHERE rn > 3 AND rn <= 11""",
        ["api_endpoints"],
    )
    def _(v, sort=_sort):
        return api.api_endpoint_list(v.api_endpoints, sort=sort, limit=8, offset=3)


@query(
    "api_endpoint_list_next",
    f"""SELECT {EP} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {EP_ORDER["last_seen"]}) AS rn
FROM api_endpoints) WHERE rn > 8 AND rn <= 16""",
    ["api_endpoints"],
)
def _(v):
    """The page behind the cursors of every tenant's first page."""
    keys = api.endpoint_keys("last_seen")
    seen = paging.cursors(api.api_endpoint_list(v.api_endpoints, sort="last_seen", limit=8), ["tenant_id"], keys)
    return api.api_endpoint_list(v.api_endpoints, sort="last_seen", limit=8, after=seen)


@query(
    "api_endpoint_list_shadow_bearer",
    f"SELECT {EP} FROM api_endpoints WHERE is_shadow AND auth_type = 'bearer'",
    ["api_endpoints"],
)
def _(v):
    return api.api_endpoint_list(v.api_endpoints, shadow_only=True, auth_type="Bearer", limit=2000)


@query(
    "api_endpoint_detail",
    f"SELECT {EP} FROM api_endpoints WHERE lb_name = 'lb-1' AND method = 'POST'",
    ["api_endpoints"],
)
def _(v):
    return inventory.detail(v.api_endpoints, lb_name="lb-1", method="POST")


STATE = "tenant_id, lb_namespace, lb_name, state, confidence_score, total_endpoints_discovered, total_traffic_samples, state_changed_at"


@query("discovery_state_list", f"SELECT {STATE} FROM states", ["states"])
def _(v):
    return api.discovery_state_list(v.states)


@query(
    "lb_api_card",
    """SELECT tenant_id, lb_namespace, lb_name, coalesce(endpoints_discovered, 0) AS endpoints_discovered,
  coalesce(shadow_count, 0) AS shadow_count, state, confidence_score, total_traffic_samples
FROM (SELECT tenant_id, lb_namespace, lb_name, count(*) AS endpoints_discovered,
        count(*) FILTER (is_shadow) AS shadow_count FROM api_endpoints GROUP BY ALL)
FULL JOIN states USING (tenant_id, lb_namespace, lb_name)""",
    ["api_endpoints", "states"],
)
def _(v):
    return api.lb_api_card(v.api_endpoints, v.states)


# --- rollups ----------------------------------------------------------------------

HOUR = "time_bucket(INTERVAL '1 hour', bucket_time)"
BOUNDS = f"""{HOUR} >= (SELECT date_trunc('hour', s - INTERVAL '7 days' + INTERVAL '3599 seconds') FROM now_)
  AND {HOUR} < (SELECT date_trunc('hour', s - INTERVAL '1 hour') FROM now_)"""


def sums(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


@query(
    "waf_rollup_1hour",
    f"""SELECT {HOUR} AS bucket_time, tenant_id, lb_namespace, lb_name,
  {sums("request_count", "blocked_count", "monitored_count", "error_count")}
FROM waf_metrics WHERE {BOUNDS.replace("bucket_time", "waf_metrics.bucket_time")} GROUP BY ALL""",
    ["waf_metrics", "now_"],
)
def _(v):
    return rollups.waf_rollup_1hour(v.waf_metrics, rollups.refresh_bounds(v.waf_metrics, v.as_of))


@query(
    "bot_rollup_1hour",
    f"""SELECT {HOUR} AS bucket_time, tenant_id, lb_namespace, lb_name,
  {sums("request_count", "challenge_count", "block_count", "allow_count")}
FROM bot_metrics WHERE {BOUNDS.replace("bucket_time", "bot_metrics.bucket_time")} GROUP BY ALL""",
    ["bot_metrics", "now_"],
)
def _(v):
    return rollups.bot_rollup_1hour(v.bot_metrics, rollups.refresh_bounds(v.bot_metrics, v.as_of))


@query(
    "api_rollup_1hour",
    f"""SELECT {HOUR} AS bucket_time, tenant_id, lb_namespace, lb_name, method, endpoint_path,
  {sums("request_count", "error_4xx_count", "error_5xx_count")},
  {rnd("avg(latency_p50_ms)", 6)} AS latency_p50_avg_ms, max(latency_p95_ms) AS latency_p95_max_ms,
  max(latency_p99_ms) AS latency_p99_max_ms
FROM api_metrics WHERE {BOUNDS.replace("bucket_time", "api_metrics.bucket_time")} GROUP BY ALL""",
    ["api_metrics", "now_"],
)
def _(v):
    from edgeline.functions.timewin import round_half_up

    out = rollups.api_rollup_1hour(v.api_metrics, rollups.refresh_bounds(v.api_metrics, v.as_of))
    # the mean is rounded only to be compared: engines add doubles in different orders
    return out.withColumn("latency_p50_avg_ms", round_half_up(F.col("latency_p50_avg_ms"), 6))


# --- cross-signal -------------------------------------------------------------------

SIGNALS = """w AS (SELECT * FROM waf_events WHERE event_time >= (SELECT t FROM now_) - INTERVAL '{h} hours'
    AND event_time <= (SELECT t FROM now_) AND source_ip IS NOT NULL),
b AS (SELECT * FROM bot_events WHERE event_time >= (SELECT t FROM now_) - INTERVAL '{h} hours'
    AND event_time <= (SELECT t FROM now_) AND source_ip IS NOT NULL),
sig AS (SELECT tenant_id, source_ip, source_asn, source_country, event_time, lb_namespace || '/' || lb_name AS lb,
    url AS endpoint, primary_signature AS signature, action = 'BLOCK' AS wb, action = 'MONITOR' AS wm, false AS bb,
    false AS bc, response_code BETWEEN 400 AND 499 AS e4, action <> 'ALLOW' AS hostile FROM w
  UNION ALL SELECT tenant_id, source_ip, source_asn, source_country, event_time, lb_namespace || '/' || lb_name,
    endpoint_path, NULL, false, false, action = 'BLOCK', action = 'CHALLENGE', false,
    action IN ('BLOCK', 'CHALLENGE', 'MONITOR') FROM b),
att AS (SELECT tenant_id, source_ip, source_asn, source_country, count(*) FILTER (wb) AS waf_block_count,
    count(*) FILTER (wm) AS waf_monitor_count, count(*) FILTER (bb) AS bot_block_count,
    count(*) FILTER (bc) AS bot_challenge_count, count(*) FILTER (e4) AS api_4xx_count,
    count(DISTINCT lb) FILTER (hostile) AS distinct_lbs, min(event_time) FILTER (hostile) AS first_seen_at,
    max(event_time) FILTER (hostile) AS last_seen_at FROM sig GROUP BY ALL),
te AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_ip, source_asn, source_country
    ORDER BY n DESC, endpoint) AS rn FROM (SELECT tenant_id, source_ip, source_asn, source_country, endpoint,
    count(*) AS n FROM sig WHERE hostile AND endpoint IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
ts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_ip, source_asn, source_country
    ORDER BY n DESC, signature) AS rn FROM (SELECT tenant_id, source_ip, source_asn, source_country, signature,
    count(*) AS n FROM sig WHERE hostile AND signature IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
profiles AS (SELECT att.*, te.endpoint AS top_endpoint, ts.signature AS top_signature,
    waf_block_count + waf_monitor_count + bot_block_count + bot_challenge_count + api_4xx_count AS total_events
  FROM att LEFT JOIN te ON te.tenant_id = att.tenant_id AND te.source_ip = att.source_ip
      AND te.source_asn IS NOT DISTINCT FROM att.source_asn
      AND te.source_country IS NOT DISTINCT FROM att.source_country
    LEFT JOIN ts ON ts.tenant_id = att.tenant_id AND ts.source_ip = att.source_ip
      AND ts.source_asn IS NOT DISTINCT FROM att.source_asn
      AND ts.source_country IS NOT DISTINCT FROM att.source_country)"""
SECURITY_VIEWS = ["waf_events", "bot_events", "now_"]


def profiles(v, hours=WEEK):
    return security.attacker_correlation(
        v.waf_events, v.bot_events, as_of=v.as_of, window=timedelta(hours=hours)
    )


@query(
    "attacker_correlation",
    f"WITH {SIGNALS.format(h=168)} SELECT * FROM profiles",
    SECURITY_VIEWS,
)
def _(v):
    return profiles(v)


@query(
    "attacker_correlation_from_hours",
    f"WITH {SIGNALS.format(h=168)} SELECT * FROM profiles",
    SECURITY_VIEWS,
)
def _(v):
    hours = security.attacker_hours(v.waf_events, v.bot_events)
    return security.attacker_correlation_from_hours(
        hours, v.waf_events, v.bot_events, as_of=v.as_of, window=timedelta(hours=WEEK)
    )


@query(
    "attacker_correlation_default_window",
    f"WITH {SIGNALS.format(h=24)} SELECT * FROM profiles WHERE total_events > 0",
    SECURITY_VIEWS,
)
def _(v):
    return security.attacker_correlation(v.waf_events, v.bot_events, as_of=v.as_of, drop_zero=True)


@query(
    "attacker_correlation_top",
    f"""WITH {SIGNALS.format(h=168)} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
  ORDER BY total_events DESC, source_ip) AS rn FROM profiles) WHERE rn <= 20""",
    SECURITY_VIEWS,
)
def _(v):
    return security.attacker_correlation(
        v.waf_events,
        v.bot_events,
        as_of=v.as_of,
        window=timedelta(hours=WEEK),
        max_attackers=20,
    )


LIST_ORDER = {
    "total": "total_events DESC",
    "waf": "waf_block_count + waf_monitor_count DESC",
    "bot": "bot_block_count + bot_challenge_count DESC",
    "last_seen": "last_seen_at DESC NULLS FIRST",
}
for _sort in LIST_ORDER:

    @query(
        f"attacker_list_{_sort}",
        f"""WITH {SIGNALS.format(h=168)} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id ORDER BY {LIST_ORDER[_sort]}, source_ip) AS rn FROM profiles) WHERE rn > 5 AND rn <= 25""",
        SECURITY_VIEWS,
    )
    def _(v, sort=_sort):
        return security.attacker_list(profiles(v), sort=sort, limit=20, offset=5)


@query(
    "attacker_list_next",
    f"""WITH {SIGNALS.format(h=168)} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id ORDER BY {LIST_ORDER["waf"]}, source_ip) AS rn FROM profiles) WHERE rn > 20 AND rn <= 40""",
    SECURITY_VIEWS,
)
def _(v):
    rows = profiles(v)
    seen = paging.cursors(security.attacker_list(rows, sort="waf", limit=20), ["tenant_id"], security.attacker_keys("waf"))
    return security.attacker_list(rows, sort="waf", limit=20, after=seen)


@query(
    "attacker_list_country",
    f"""WITH {SIGNALS.format(h=168)} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
  ORDER BY total_events DESC, source_ip) AS rn FROM profiles WHERE source_country = 'DE') WHERE rn <= 50""",
    SECURITY_VIEWS,
)
def _(v):
    return security.attacker_list(profiles(v), country="de")


TIMELINE = """SELECT tenant_id, source_ip, event_time, id, action, lb_name, method, 'waf' AS signal, url AS endpoint,
  primary_signature AS classifier, response_code AS rsp_code, severity, NULL AS extra FROM waf_events
  WHERE {w} AND source_ip IS NOT NULL
UNION ALL SELECT tenant_id, source_ip, event_time, id, action, lb_name, method, 'bot', endpoint_path, bot_category,
  NULL, NULL, '{{' || CASE WHEN confidence_score IS NULL THEN '' ELSE '"confidence_score":' || confidence_score || ','
  END || '"challenge_result":"' || challenge_result || '"}}' FROM bot_events WHERE {w} AND source_ip IS NOT NULL"""
IN_WEEK = "event_time >= (SELECT t FROM now_) - INTERVAL '168 hours' AND event_time <= (SELECT t FROM now_)"


@query(
    "attacker_timeline",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_ip ORDER BY event_time DESC,
  signal DESC, id) AS rn FROM ({TIMELINE.format(w=IN_WEEK)})) WHERE rn <= 20""",
    SECURITY_VIEWS,
)
def _(v):
    return security.attacker_timeline(
        v.waf_events, v.bot_events, as_of=v.as_of, window=timedelta(hours=WEEK), limit=20
    )


@query(
    "attacker_timeline_one_address",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_ip ORDER BY event_time DESC,
  signal DESC, id) AS rn FROM ({TIMELINE.format(w=IN_WEEK)}) WHERE source_ip = '10.0.0.5') WHERE rn <= 200""",
    SECURITY_VIEWS,
)
def _(v):
    return security.attacker_timeline(
        v.waf_events,
        v.bot_events,
        as_of=v.as_of,
        source_ip="10.0.0.5",
        window=timedelta(hours=WEEK),
    )


HOSTILE = {
    "waf": "SELECT tenant_id, source_country AS country FROM waf_events WHERE {w} AND action IN ('BLOCK', 'MONITOR')",
    "bot": "SELECT tenant_id, source_country AS country FROM bot_events WHERE {w} AND action IN ('BLOCK', 'CHALLENGE', 'MONITOR')",
}
HOSTILE["all"] = HOSTILE["waf"] + " UNION ALL " + HOSTILE["bot"]
for _signal in HOSTILE:

    @query(
        f"geo_counts_{_signal}",
        f"""SELECT tenant_id, country, count(*) AS count FROM ({HOSTILE[_signal].format(w=OPEN_WEEK)})
WHERE country IS NOT NULL GROUP BY ALL""",
        SECURITY_VIEWS,
    )
    def _(v, signal=_signal):
        return security.geo_counts(
            v.waf_events, v.bot_events, as_of=v.as_of, hours=WEEK, signal=signal
        )


ALERTS = """SELECT 't' || (o_custkey % 3) AS tenant_id, 'rule-' || (o_orderkey % 6) AS rule_id,
  'key:' || o_orderkey AS dedupe_key,
  CASE o_orderkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'acknowledged' ELSE 'resolved' END AS status
FROM orders"""


@query(
    "security_overview",
    f"""WITH {SIGNALS.format(h=168)}, alerts AS ({ALERTS}),
wc AS (SELECT tenant_id, source_country, count(*) AS n FROM waf_events WHERE {OPEN_DAY}
  AND action IN ('BLOCK', 'MONITOR') AND source_country IS NOT NULL GROUP BY ALL),
tc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, source_country) AS rn
  FROM wc) WHERE rn = 1)
SELECT p.tenant_id, total_attackers, countries_seen, tc.source_country AS top_country,
  coalesce(tc.n, 0) AS top_country_count, total_waf_blocks, total_api_4xx, total_bot_interventions, open_alerts,
  critical_alerts
FROM (SELECT tenant_id, count(*) AS total_attackers, count(DISTINCT source_country) AS countries_seen
      FROM profiles GROUP BY tenant_id) p
LEFT JOIN tc ON tc.tenant_id = p.tenant_id
LEFT JOIN (SELECT tenant_id, count(*) FILTER (action = 'BLOCK') AS total_waf_blocks,
    count(*) FILTER (response_code BETWEEN 400 AND 499) AS total_api_4xx FROM waf_events WHERE {OPEN_DAY}
  GROUP BY tenant_id) x ON x.tenant_id = p.tenant_id
LEFT JOIN (SELECT tenant_id, count(*) FILTER (action IN ('BLOCK', 'CHALLENGE')) AS total_bot_interventions
  FROM bot_events WHERE {OPEN_DAY} GROUP BY tenant_id) y ON y.tenant_id = p.tenant_id
LEFT JOIN (SELECT tenant_id, count(*) FILTER (status = 'open') AS open_alerts,
    count(*) FILTER (status = 'open' AND severity = 'critical') AS critical_alerts FROM alerts GROUP BY tenant_id) z
  ON z.tenant_id = p.tenant_id""",
    SECURITY_VIEWS,
)
def _(v):
    from edgeline.plans.alert_queries import order_alerts

    return security.security_overview(
        profiles(v), v.waf_events, v.bot_events, order_alerts(v), as_of=v.as_of
    )


@query(
    "metric_totals_per_sync",
    "SELECT state, count(*) AS rows FROM states GROUP BY state",
    ["states"],
)
def _(v):
    return series.metric_totals_per_sync(v.states, "state")


# --- set operations -------------------------------------------------------------------


@query(
    "union_of_signals",
    f"""WITH {SIGNALS.format(h=168)} SELECT tenant_id, lb, count(*) AS signals, count(*) FILTER (hostile) AS hostile,
  count(*) FILTER (wb) AS waf_block, count(*) FILTER (bc) AS bot_challenge FROM sig GROUP BY ALL""",
    SECURITY_VIEWS,
)
def _(v):
    from edgeline.functions.timewin import within

    recent = [
        within(df, "event_time", v.as_of, timedelta(hours=WEEK), to_second=False).filter(
            "source_ip IS NOT NULL"
        )
        for df in (v.waf_events, v.bot_events)
    ]
    return security.attack_signals(*recent).groupBy("tenant_id", "lb").agg(
        F.count("*").alias("signals"),
        F.count_if("hostile").alias("hostile"),
        F.count_if("waf_block").alias("waf_block"),
        F.count_if("bot_challenge").alias("bot_challenge"),
    )


@query(
    "distinct_sources",
    """SELECT DISTINCT tenant_id, source_ip, source_country FROM waf_events
UNION SELECT DISTINCT tenant_id, source_ip, source_country FROM bot_events""",
    ["waf_events", "bot_events"],
)
def _(v):
    return series.distinct_values(
        ["tenant_id", "source_ip", "source_country"], v.waf_events, v.bot_events
    )


@query(
    "distinct_counts",
    """SELECT tenant_id, count(DISTINCT source_country) AS countries, count(DISTINCT source_ip) AS addresses,
  count(DISTINCT lb_namespace || '/' || lb_name) AS lbs FROM waf_events GROUP BY tenant_id""",
    ["waf_events"],
)
def _(v):
    return series.distinct_counts(
        v.waf_events.withColumn("lb", F.concat_ws("/", "lb_namespace", "lb_name")),
        {"countries": "source_country", "addresses": "source_ip", "lbs": "lb"},
    )


SEEN = " UNION ALL ".join(
    f"SELECT tenant_id, event_time, '{c}' AS name, {c} AS value FROM waf_events WHERE {c} IS NOT NULL"
    for c in ("source_ip", "source_country", "url")
)
NOW_HOUR = "(SELECT date_trunc('hour', t) FROM now_)"


@query(
    "distinct_over_hours",
    f"""SELECT tenant_id, name, count(DISTINCT value) AS distinct_values FROM ({SEEN})
WHERE event_time >= {NOW_HOUR} - INTERVAL '167 hours' GROUP BY ALL""",
    ["waf_events", "now_"],
)
def _(v):
    """From hourly sketches, exact up to 16,384 values of a tenant's column."""
    hours = sketches.distinct_hours(v.waf_events, ["source_ip", "source_country", "url"])
    return sketches.distinct_over(hours, as_of=v.as_of, window_hours=WEEK)


@query(
    "new_values_against_week",
    f"""SELECT tenant_id, name, count(*) AS distinct_values, count(*) FILTER (NOT before) AS new_values FROM (
  SELECT tenant_id, name, value, bool_or(event_time < {NOW_HOUR} - INTERVAL '23 hours') AS before,
    bool_or(event_time >= {NOW_HOUR} - INTERVAL '23 hours') AS recent
  FROM ({SEEN}) WHERE event_time >= {NOW_HOUR} - INTERVAL '191 hours' GROUP BY ALL) WHERE recent GROUP BY ALL""",
    ["waf_events", "now_"],
)
def _(v):
    hours = sketches.distinct_hours(v.waf_events, ["source_ip", "source_country", "url"])
    return sketches.new_against(hours, as_of=v.as_of, window_hours=24, prior_hours=WEEK)
