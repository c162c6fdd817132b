"""The views as DuckDB SQL, each derived from the parquet tables by its own path."""

from __future__ import annotations

PCT = "CASE WHEN {t} > 0 THEN floor({p}::DOUBLE / {t}::DOUBLE * 100.0 * {f} + 0.5) / {f} ELSE 0.0 END"


def pct(part: str, total: str, digits: int = 2) -> str:
    return PCT.format(p=f"({part})", t=f"({total})", f=float(10**digits))


def rnd(x: str, digits: int) -> str:
    f = float(10**digits)
    return f"(floor(({x}) * {f} + 0.5) / {f})"


METHOD = "CASE k % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END"
ADDRESS = """
  CASE WHEN user_id % 50 <> 49 THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS source_ip,
  CASE user_id % 9 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'GB' WHEN 4 THEN 'NL'
    WHEN 5 THEN 'BR' WHEN 6 THEN 'IN' WHEN 7 THEN 'JP' END AS source_country,
  CASE WHEN user_id % 7 <> 6 THEN user_id % 7 + 64500 END AS source_asn"""
WHERE = "'t' || (user_id % 3) AS tenant_id, 'ns' || (k % 2) AS lb_namespace, 'lb-' || (k % 10) AS lb_name"
HEALTH = """
  SELECT tenant_id, pool_id, origin_address, origin_port, site_name, raw_status,
    CASE upper(raw_status) WHEN 'HEALTHY' THEN 'healthy' WHEN 'UNHEALTHY' THEN 'unhealthy'
      WHEN 'UNKNOWN' THEN 'warning' WHEN 'STARTING' THEN 'warning' WHEN 'DRAINING' THEN 'info'
      ELSE 'unknown' END AS classified_status,
    fails AS consecutive_failures, l_shipdate AS last_probe_at
  FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, pool_id, origin_address, origin_port, site_name
          ORDER BY l_shipdate DESC, raw_status DESC, fails DESC) AS rn
        FROM (SELECT {tenant} AS tenant_id, {pool} AS pool_id, '10.1.0.' || l_partkey AS origin_address,
                CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS origin_port, {site} AS site_name,
                CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'HEALTHY' WHEN 'AO' THEN 'STARTING'
                  WHEN 'NF' THEN 'UNHEALTHY' WHEN 'NO' THEN 'DRAINING' WHEN 'RF' THEN 'healthy'
                  ELSE 'OFFLINE' END AS raw_status,
                CAST(floor(l_quantity) AS INTEGER) AS fails, l_shipdate
              FROM lineitem)) WHERE rn = 1"""

CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "now_": ([], "SELECT max(ts) AS t, date_trunc('second', max(ts)) AS s FROM events"),
    "waf_events": (
        ["ev"],
        f"""SELECT event_id, 'e' || event_id AS id, ts AS event_time, {WHERE},
  CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'signup' THEN 'MONITOR' ELSE 'ALLOW' END AS action, {ADDRESS},
  {METHOD} AS method, '/api/v' || (k % 5) || '/r' || (k % 20) AS url,
  CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 403 WHEN 1 THEN 404 ELSE 500 END ELSE 200 END
    AS response_code,
  CASE WHEN event_type IN ('error', 'signup') THEN 'SIG_' || (k % 12) END AS primary_signature,
  CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'medium' ELSE 'high' END AS severity, k, value
FROM ev""",
    ),
    "bot_events": (
        ["ev"],
        f"""SELECT event_id, 'b' || event_id AS id, ts AS event_time, {WHERE},
  CASE k % 8 WHEN 0 THEN 'BLOCK' WHEN 2 THEN 'CHALLENGE' WHEN 4 THEN 'MONITOR' ELSE 'ALLOW' END AS action,
  CASE event_type WHEN 'signup' THEN 'bad_bot' WHEN 'error' THEN 'good_bot' WHEN 'click' THEN 'scraper'
    WHEN 'view' THEN 'automation' ELSE 'unknown' END AS bot_category,
  CASE WHEN k % 10 <> 0 THEN CAST(floor(value) AS INTEGER) % 101 END AS confidence_score,
  CASE WHEN k % 10 = 0 THEN 'unknown' WHEN CAST(floor(value) AS INTEGER) % 101 >= 80 THEN 'high'
    WHEN CAST(floor(value) AS INTEGER) % 101 >= 50 THEN 'medium' ELSE 'low' END AS confidence_bucket,
  CASE WHEN k % 4 = 0 THEN 'not_issued' WHEN k % 3 = 0 THEN 'failed' WHEN k % 3 = 1 THEN 'passed'
    WHEN k % 8 = 2 THEN 'abandoned' ELSE 'not_issued' END AS challenge_result,
  CASE WHEN k % 8 = 2 THEN 'js' END AS challenge_type,
  CASE k % 13 WHEN 0 THEN 'googlebot' WHEN 1 THEN 'bingbot' WHEN 2 THEN 'search_other' WHEN 3 THEN 'curl'
    WHEN 4 THEN 'wget' WHEN 5 THEN 'python_http' WHEN 6 THEN 'language_runtime' WHEN 7 THEN 'api_tool'
    WHEN 8 THEN 'headless_browser' WHEN 9 THEN 'chrome' WHEN 10 THEN 'firefox' WHEN 11 THEN 'safari'
    ELSE 'customagent' END AS ua_family,
  CASE k % 4 WHEN 0 THEN 'standard' ELSE 'bd_advanced' END AS source, {ADDRESS},
  {METHOD} AS method, '/api/v' || (k % 5) || '/r' || (k % 20) AS endpoint_path, k
FROM ev""",
    ),
    "waf_metrics": (
        ["waf_events"],
        """SELECT time_bucket(INTERVAL '1 minute', event_time) AS bucket_time, tenant_id, lb_namespace, lb_name,
  count(*) AS request_count, count(*) FILTER (action = 'BLOCK') AS blocked_count,
  count(*) FILTER (action = 'MONITOR') AS monitored_count, count(*) FILTER (action = 'ALLOW') AS error_count
FROM waf_events GROUP BY ALL""",
    ),
    "bot_metrics": (
        ["bot_events"],
        """SELECT time_bucket(INTERVAL '1 minute', event_time) AS bucket_time, tenant_id, lb_namespace, lb_name,
  count(*) AS request_count, count(*) FILTER (action = 'CHALLENGE') AS challenge_count,
  count(*) FILTER (action = 'BLOCK') AS block_count, count(*) FILTER (action = 'ALLOW') AS allow_count
FROM bot_events GROUP BY ALL""",
    ),
    "api_metrics": (
        ["waf_events"],
        """SELECT time_bucket(INTERVAL '1 minute', event_time) AS bucket_time, tenant_id, lb_namespace, lb_name,
  method, url AS endpoint_path, count(*) AS request_count,
  count(*) FILTER (response_code BETWEEN 400 AND 499) AS error_4xx_count,
  count(*) FILTER (response_code >= 500) AS error_5xx_count,
  quantile_cont(value, 0.5) AS latency_p50_ms, quantile_cont(value, 0.95) AS latency_p95_ms,
  quantile_cont(value, 0.99) AS latency_p99_ms
FROM waf_events GROUP BY ALL""",
    ),
    "event_lbs": (
        ["ev"],
        """SELECT tenant_id, lb_namespace AS namespace, lb_name AS name, j, j % 2 = 0 AS has_waf,
  j % 3 = 0 AS has_bot_defense
FROM (SELECT DISTINCT 't' || (user_id % 3) AS tenant_id, 'ns' || (k % 2) AS lb_namespace,
        'lb-' || (k % 10) AS lb_name, k % 10 AS j FROM ev)""",
    ),
    "event_attachments": (
        ["event_lbs"],
        """SELECT tenant_id, 'app_firewall' AS policy_type, 'shared' AS policy_namespace,
  'fw-' || (j % 3) AS policy_name, namespace AS lb_namespace, name AS lb_name FROM event_lbs WHERE j % 2 = 0
UNION ALL
SELECT tenant_id, 'api_definition', 'shared', 'def-' || (j % 5), namespace, name FROM event_lbs WHERE j < 8""",
    ),
    "api_endpoints": (
        ["waf_events"],
        """SELECT tenant_id, lb_namespace, lb_name, method, url AS endpoint_path,
  count(*) AS total_request_samples, min(event_time) AS first_seen_at, max(event_time) AS last_seen_at,
  list_sort(list_distinct(list(response_code))) AS response_codes,
  CASE min(k) % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'basic' WHEN 2 THEN 'bearer' WHEN 3 THEN 'oauth'
    WHEN 4 THEN 'apikey' WHEN 5 THEN 'unknown' END AS auth_type,
  NOT (min(k % 20) < 12 AND min(k % 10) < 8) AS is_shadow
FROM waf_events GROUP BY ALL""",
    ),
    "states": (
        ["waf_events", "now_"],
        """SELECT *, CASE j % 5 WHEN 0 THEN 'learning' WHEN 1 THEN 'mature' WHEN 2 THEN 'enforcing'
    WHEN 3 THEN 'disabled' ELSE 'unknown' END AS state,
  CASE WHEN j <> 0 THEN j * 10 END AS confidence_score,
  (SELECT t FROM now_) - j * 2 * INTERVAL '1 minute' AS state_changed_at
FROM (SELECT tenant_id, lb_namespace, lb_name, min(k % 10) AS j, count(*) AS total_traffic_samples,
        count(DISTINCT url) AS total_endpoints_discovered FROM waf_events GROUP BY ALL)""",
    ),
    "load_balancers": (
        [],
        """SELECT s_suppkey AS k, 't' || (s_suppkey % 3) AS tenant_id, 'ns' || (s_suppkey % 4) AS namespace, s_name AS name,
  lower(s_name) || '.example.com' AS domains,
  CASE s_suppkey % 4 WHEN 0 THEN 'https' WHEN 1 THEN 'https' WHEN 2 THEN 'http' ELSE 'unknown' END AS lb_type,
  CASE s_suppkey % 5 WHEN 0 THEN 'advertise_on_public_default_vip' WHEN 1 THEN 'advertise_on_public'
    WHEN 2 THEN 'advertise_custom' WHEN 3 THEN 'do_not_advertise' END AS advertise_mode,
  CASE WHEN s_suppkey % 5 IN (0, 1) THEN '__all_re__'
    WHEN s_suppkey % 5 = 2 THEN 'ny' || (s_suppkey % 25) || '-nyc,virtual:vs' || (s_suppkey % 4) ELSE '' END AS advertised_sites,
  s_suppkey % 2 = 0 AS has_waf, s_suppkey % 5 = 0 OR s_suppkey % 13 = 0 AS has_service_policy,
  s_suppkey % 3 = 0 OR s_suppkey % 10 = 1 AS has_bot_defense, s_suppkey % 7 = 0 AS has_api_protection,
  'pool-' || s_suppkey || ',pool-' || (s_suppkey * 7 % 50) AS origin_pool_refs, 'ns0,ns1' AS origin_pool_ref_namespaces,
  CASE WHEN s_suppkey % 4 = 1 THEN 'cert-' || s_suppkey END AS cert_ref FROM supplier""",
    ),
    "sites": (
        [],
        """SELECT t.tenant_id, CASE WHEN n_nationkey % 2 = 0 THEN 'ny' || n_nationkey || '-nyc' ELSE 'branch_' || n_nationkey END
    AS name,
  CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 5 = 0 THEN 're' WHEN n_nationkey % 3 = 0 AND n_nationkey % 5 = 1 THEN 'ce'
    WHEN n_nationkey % 3 = 0 AND n_nationkey % 5 = 2 THEN 'ig' WHEN n_nationkey % 3 = 0 AND n_nationkey % 5 = 3 THEN 'virtual'
    WHEN n_nationkey % 2 = 0 THEN 're' ELSE 'unknown' END AS site_type, 'ONLINE' AS operational_status,
  'region-' || n_regionkey AS region, 'aws' AS provider
FROM nation, (VALUES ('t0'), ('t1'), ('t2')) t(tenant_id)""",
    ),
    "certificates": (
        [],
        """SELECT 't' || (o_custkey % 3) AS tenant_id, 'ns' || (o_orderkey % 4) AS namespace,
  'cert-' || o_orderkey AS name, 'CN' || o_custkey AS subject,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL '90 days' END AS not_after FROM orders""",
    ),
    "cert_status": (
        ["certificates"],
        """SELECT *, CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'expired' WHEN d <= 7 THEN 'critical'
    WHEN d <= 30 THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT *, CAST(floor((epoch_us(not_after) - epoch_us(TIMESTAMP '1998-06-01 00:00:00')) / 86400000000.0)
        AS INTEGER) AS d FROM certificates)""",
    ),
    "origin_pools": (
        [],
        """SELECT 't' || (s_suppkey % 3) AS tenant_id, 'p' || s_suppkey AS pool_id, 'ns' || (s_suppkey % 4) AS namespace,
  'pool-' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 443 ELSE 80 END AS port,
  CASE s_suppkey % 3 WHEN 0 THEN 'ROUND_ROBIN' WHEN 1 THEN 'LEAST_ACTIVE' END AS lb_algorithm,
  CAST(s_suppkey % 5 AS INTEGER) AS origin_count, 0 AS healthy_count, s_suppkey % 2 AS unhealthy_count,
  0 AS warning_count FROM supplier""",
    ),
    "origin_health": (
        [],
        HEALTH.format(
            tenant="'t' || (l_suppkey % 3)",
            pool="'p' || l_suppkey",
            site="'site-' || (l_orderkey % 25)",
        ),
    ),
    "order_health": (
        [],
        HEALTH.format(
            tenant="'t' || (l_orderkey % 3)",
            pool="'o' || l_orderkey",
            site="'site-' || (l_suppkey % 25)",
        ),
    ),
    "policies": (
        [],
        """SELECT 't' || (c_custkey % 3) AS tenant_id, CASE c_custkey % 4 WHEN 0 THEN 'app_firewall'
    WHEN 1 THEN 'service_policy' WHEN 2 THEN 'bot_defense_policy' ELSE 'api_definition' END AS policy_type,
  CASE WHEN c_nationkey = 0 THEN 'shared' ELSE 'ns' || (c_custkey % 3) END AS namespace,
  'pol-' || c_custkey AS name, c_nationkey = 0 AS is_shared FROM customer""",
    ),
    "attachments": (
        ["policies"],
        """SELECT DISTINCT p.tenant_id, p.policy_type, p.namespace AS policy_namespace,
  CASE WHEN o_orderkey % 17 = 0 OR o_custkey % 5 = 0 THEN 'ghost-' || o_custkey ELSE 'pol-' || o_custkey END AS policy_name,
  'ns' || (o_orderkey % 10 % 2) AS lb_namespace, 'lb-' || (o_orderkey % 10) AS lb_name
FROM orders JOIN policies p ON p.name = 'pol-' || o_custkey""",
    ),
}


def with_views(sql: str, uses: list[str]) -> str:
    """``sql`` preceded by the views it uses, and the views those use."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in uses:
        add(name)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
