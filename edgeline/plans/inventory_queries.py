"""Lists, counts and look-ups over the current-state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.operators import inventory, joins
from edgeline.plans.config_queries import LB, SITE_KIND, health_sites, load_balancers, sites
from edgeline.plans.ctes import pct
from edgeline.plans.registry import query
from edgeline.plans.views import word

# --- load balancers -------------------------------------------------------------


@query("lb_list", f"SELECT {LB} FROM load_balancers WHERE namespace = 'ns1'", ["load_balancers"])
def _(v):
    return inventory.lb_list(load_balancers(v), "ns1").drop("raw_spec")


@query(
    "lb_detail",
    f"SELECT {LB} FROM load_balancers WHERE tenant_id = 't1' AND namespace = 'ns1'",
    ["load_balancers"],
)
def _(v):
    return inventory.detail(load_balancers(v), tenant_id="t1", namespace="ns1").drop("raw_spec")


LB_STATS = """SELECT tenant_id, count(*) AS total, count(*) FILTER (has_waf) AS with_waf,
  count(*) FILTER (has_bot_defense) AS with_bot_defense, count(*) FILTER (has_api_protection) AS with_api_protection,
  count(*) FILTER (has_service_policy) AS with_service_policy, count(*) FILTER (lb_type = 'https') AS https,
  count(*) FILTER (lb_type = 'http') AS http_only FROM load_balancers GROUP BY tenant_id"""


@query("lb_stats", LB_STATS, ["load_balancers"])
def _(v):
    return inventory.lb_stats(load_balancers(v))


@query(
    "coverage_pct",
    f"""SELECT tenant_id, total, CAST({pct("with_waf", "total", 0)} AS INTEGER) AS pct_waf,
  CAST({pct("with_bot_defense", "total", 0)} AS INTEGER) AS pct_bot_defense,
  CAST({pct("with_api_protection", "total", 0)} AS INTEGER) AS pct_api_protection,
  CAST({pct("with_service_policy", "total", 0)} AS INTEGER) AS pct_service_policy,
  CAST({pct("https", "total", 0)} AS INTEGER) AS pct_https FROM ({LB_STATS})""",
    ["load_balancers"],
)
def _(v):
    return inventory.coverage_pct(load_balancers(v))


@query(
    "lb_pools",
    """SELECT l.tenant_id, l.namespace AS lb_namespace, l.name AS lb_name, p.name AS pool_name,
  p.namespace AS pool_namespace, p.pool_id
FROM (SELECT DISTINCT tenant_id, namespace, name, unnest(string_split(origin_pool_refs, ',')) AS ref FROM load_balancers) l
JOIN origin_pools p ON p.tenant_id = l.tenant_id AND p.name = l.ref""",
    ["load_balancers", "origin_pools"],
)
def _(v):
    out = joins.lb_pools(load_balancers(v), v.origin_pools)
    return out.select(
        "tenant_id", "lb_namespace", "lb_name", "pool_name", "pool_namespace", "pool_id"
    )


@query(
    "lb_pools_same_namespace",
    """SELECT l.tenant_id, l.namespace AS lb_namespace, l.name AS lb_name, p.name AS pool_name,
  p.namespace AS pool_namespace
FROM (SELECT tenant_id, namespace, name, 'pool-' || k AS ref, 'ns0' AS ref_ns FROM load_balancers
      UNION SELECT tenant_id, namespace, name, 'pool-' || (k * 7 % 50), 'ns1' FROM load_balancers) l
JOIN origin_pools p ON p.tenant_id = l.tenant_id AND p.name = l.ref AND p.namespace = l.ref_ns""",
    ["load_balancers", "origin_pools"],
)
def _(v):
    out = joins.lb_pools(load_balancers(v), v.origin_pools, match_namespace=True)
    return out.select("tenant_id", "lb_namespace", "lb_name", "pool_name", "pool_namespace")


@query(
    "probe_targets",
    """WITH refs AS (SELECT DISTINCT tenant_id, pool_name, unnest(string_split(advertised_sites, ',')) AS ref FROM (
  SELECT tenant_id, unnest(string_split(origin_pool_refs, ',')) AS pool_name, advertised_sites FROM load_balancers
  WHERE advertised_sites <> '')),
known AS (SELECT r.* FROM refs r WHERE EXISTS (SELECT 1 FROM origin_pools p WHERE p.tenant_id = r.tenant_id
  AND p.name = r.pool_name))
SELECT tenant_id, pool_name, replace(ref, 'virtual:', '') AS site_name FROM known WHERE ref <> '__all_re__'
UNION SELECT k.tenant_id, pool_name, s.name FROM known k JOIN sites s ON s.tenant_id = k.tenant_id
WHERE ref = '__all_re__' AND site_type = 're'""",
    ["load_balancers", "origin_pools", "sites"],
)
def _(v):
    return joins.probe_targets(load_balancers(v), sites(v), v.origin_pools)


@query(
    "probe_targets_long_names",
    """SELECT DISTINCT p.tenant_id, p.name AS pool_name, repeat('v', 300) || p.pool_id AS site_name FROM origin_pools p""",
    ["origin_pools"],
)
def _(v):
    name = F.concat(F.lit("v" * 300), F.col("pool_id"))
    lbs = v.origin_pools.select(
        "tenant_id",
        F.array("name").alias("origin_pool_refs"),
        F.array(F.concat(F.lit("virtual:"), name)).alias("advertised_sites"),
    )
    return joins.probe_targets(lbs, sites(v), v.origin_pools)


# --- certificates -----------------------------------------------------------------

CERT = "tenant_id, namespace, name, subject, not_after, d AS days_until_expiry, status"


@query("certificate_list", f"SELECT {CERT} FROM cert_status", ["cert_status"])
def _(v):
    return inventory.certificates_by_expiry(v.certificates, as_of=v.cert_as_of)


@query(
    "certificate_list_critical",
    f"SELECT {CERT} FROM cert_status WHERE status = 'critical'",
    ["cert_status"],
)
def _(v):
    return inventory.certificates_by_expiry(
        v.certificates, as_of=v.cert_as_of, status="critical"
    )


@query(
    "certificate_get",
    f"SELECT {CERT} FROM cert_status WHERE name = 'cert-42'",
    ["cert_status"],
)
def _(v):
    rows = inventory.detail(v.certificates, name="cert-42")
    return inventory.certificate_list(rows, as_of=v.cert_as_of)


@query(
    "cert_stats",
    """SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'critical') AS critical,
  count(*) FILTER (status = 'expired') AS expired FROM cert_status GROUP BY tenant_id""",
    ["cert_status"],
)
def _(v):
    return inventory.cert_stats(v.certificates, as_of=v.cert_as_of)


# --- pools and health ---------------------------------------------------------------


@query(
    "pool_health_rollup",
    """SELECT p.tenant_id, p.pool_id, namespace, name, port, lb_algorithm, origin_count,
  CASE WHEN port = 443 THEN coalesce(h, 0) ELSE healthy_count END AS healthy_count,
  CASE WHEN port = 443 THEN coalesce(u, 0) ELSE unhealthy_count END AS unhealthy_count,
  CASE WHEN port = 443 THEN coalesce(w, 0) ELSE warning_count END AS warning_count,
  CASE WHEN port = 443 THEN TIMESTAMP '1998-06-01' END AS last_healthcheck_at
FROM origin_pools p LEFT JOIN (SELECT tenant_id, pool_id, count(*) FILTER (classified_status = 'healthy') AS h,
  count(*) FILTER (classified_status = 'unhealthy') AS u, count(*) FILTER (classified_status = 'warning') AS w
  FROM origin_health GROUP BY ALL) c ON c.tenant_id = p.tenant_id AND c.pool_id = p.pool_id""",
    ["origin_pools", "origin_health"],
)
def _(v):
    touched = v.origin_pools.filter("port = 443")
    return inventory.pool_health_rollup(
        v.origin_pools, v.origin_health, touched, at=v.cert_as_of
    )


@query(
    "pool_stats",
    """SELECT p.tenant_id, total_pools, pools_with_unhealthy, pools_with_warnings, total_origins,
  coalesce(unhealthy_cells, 0) AS unhealthy_cells, coalesce(warning_cells, 0) AS warning_cells
FROM (SELECT tenant_id, count(*) AS total_pools, count(*) FILTER (unhealthy_count > 0) AS pools_with_unhealthy,
  count(*) FILTER (warning_count > 0) AS pools_with_warnings, CAST(sum(origin_count) AS BIGINT) AS total_origins
  FROM origin_pools GROUP BY tenant_id) p
LEFT JOIN (SELECT tenant_id, count(*) FILTER (classified_status = 'unhealthy') AS unhealthy_cells,
  count(*) FILTER (classified_status = 'warning') AS warning_cells FROM origin_health GROUP BY tenant_id) h
  USING (tenant_id)""",
    ["origin_pools", "origin_health"],
)
def _(v):
    return inventory.pool_stats(v.origin_pools, v.origin_health)


@query(
    "pool_list",
    """SELECT tenant_id, pool_id, namespace, name, port, lb_algorithm, origin_count, healthy_count, unhealthy_count,
  warning_count FROM origin_pools""",
    ["origin_pools"],
)
def _(v):
    return inventory.pool_list(v.origin_pools).drop("last_healthcheck_at")


@query(
    "pool_detail",
    """SELECT h.tenant_id, h.pool_id, namespace, name, port, lb_algorithm, origin_count, origin_address, origin_port,
  site_name, raw_status, classified_status, consecutive_failures, last_probe_at, sites
FROM origin_health h JOIN origin_pools p ON p.tenant_id = h.tenant_id AND p.pool_id = h.pool_id
JOIN (SELECT tenant_id, pool_id, array_to_string(list_sort(list_distinct(list(site_name))), ',') AS sites
  FROM origin_health GROUP BY tenant_id, pool_id) s ON s.tenant_id = h.tenant_id AND s.pool_id = h.pool_id""",
    ["origin_pools", "origin_health"],
)
def _(v):
    return inventory.pool_detail(v.origin_pools, v.origin_health)


BY_ORIGIN = """SELECT tenant_id, pool_id, origin_address, origin_port, count(*) AS total,
  count(*) FILTER (classified_status = 'healthy') AS healthy, count(*) FILTER (classified_status = 'unhealthy') AS unhealthy,
  count(*) FILTER (classified_status = 'warning') AS warning, count(*) FILTER (classified_status = 'info') AS info,
  count(*) FILTER (classified_status = 'unknown') AS unknown"""


@query("health_by_origin", f"{BY_ORIGIN} FROM origin_health GROUP BY ALL", ["origin_health"])
def _(v):
    return inventory.health_by_origin(v.origin_health)


@query(
    "health_site_type",
    f"""SELECT tenant_id, pool_id, origin_address, origin_port, site_name, classified_status, {SITE_KIND}
FROM origin_health""",
    ["origin_health"],
)
def _(v):
    out = joins.health_site_type(v.origin_health, health_sites(v))
    return out.drop("raw_status", "consecutive_failures", "last_probe_at")


POOL_SITES = "SELECT tenant_id, pool_id, count(DISTINCT site_name) AS sites FROM order_health GROUP BY ALL"
ORIGIN_SITES = """SELECT tenant_id, pool_id, origin_address, origin_port, count(DISTINCT site_name) AS probed
FROM order_health GROUP BY ALL"""


@query(
    "health_matrix",
    f"""SELECT h.tenant_id, h.pool_id, h.origin_address, h.origin_port, h.site_name, h.classified_status AS status,
  h.consecutive_failures, s.sites - o.probed AS sites_without_probe
FROM order_health h JOIN ({POOL_SITES}) s ON s.tenant_id = h.tenant_id AND s.pool_id = h.pool_id
JOIN ({ORIGIN_SITES}) o ON o.tenant_id = h.tenant_id AND o.pool_id = h.pool_id AND o.origin_address = h.origin_address
  AND o.origin_port IS NOT DISTINCT FROM h.origin_port""",
    ["order_health"],
)
def _(v):
    return joins.health_matrix(v.order_health)


@query("health_matrix_large_pools", f"{BY_ORIGIN} FROM order_health GROUP BY ALL", ["order_health"])
def _(v):
    return inventory.health_by_origin(v.order_health)


GRID = """o AS (SELECT DISTINCT tenant_id, pool_id, origin_address, origin_port FROM {t}),
s AS (SELECT DISTINCT tenant_id, pool_id, site_name FROM {t}),
grid AS (SELECT o.*, s.site_name, coalesce(h.classified_status, 'no probe') AS status, h.consecutive_failures
  FROM o JOIN s ON s.tenant_id = o.tenant_id AND s.pool_id = o.pool_id
  LEFT JOIN {t} h ON h.tenant_id = o.tenant_id AND h.pool_id = o.pool_id AND h.origin_address = o.origin_address
    AND h.origin_port IS NOT DISTINCT FROM o.origin_port AND h.site_name = s.site_name)"""


@query("health_grid", f"WITH {GRID.format(t='order_health')} SELECT * FROM grid", ["order_health"])
def _(v):
    return joins.health_grid(v.order_health)


@query("health_grid_few_pools", f"WITH {GRID.format(t='origin_health')} SELECT * FROM grid", ["origin_health"])
def _(v):
    return joins.health_grid(v.origin_health)


@query(
    "health_grid_by_origin",
    f"""WITH {GRID.format(t='order_health')} SELECT tenant_id, pool_id, origin_address, origin_port,
  count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status <> 'no probe') AS probes,
  count(*) FILTER (status = 'no probe') AS no_probe,
  coalesce(string_agg(site_name, ',' ORDER BY site_name) FILTER (status = 'no probe'), '') AS blind_sites
FROM grid GROUP BY ALL""",
    ["order_health"],
)
def _(v):
    return joins.health_grid_by_origin(v.order_health)


# --- policies --------------------------------------------------------------------------

ATTACHED = """EXISTS (SELECT 1 FROM attachments a WHERE a.tenant_id = p.tenant_id AND a.policy_type = p.policy_type
  AND a.policy_namespace = p.namespace AND a.policy_name = p.name)"""


@query(
    "unattached_policies",
    f"SELECT * FROM policies p WHERE NOT {ATTACHED}",
    ["policies", "attachments"],
)
def _(v):
    return joins.unattached_policies(v.policies, v.attachments)


@query(
    "policy_stats",
    f"""SELECT tenant_id, policy_type, count(*) AS total, count(*) FILTER (is_shared) AS shared,
  count(*) FILTER (NOT is_shared) AS local, count(*) FILTER (NOT attached) AS unattached
FROM (SELECT p.*, {ATTACHED} AS attached FROM policies p) GROUP BY ALL""",
    ["policies", "attachments"],
)
def _(v):
    return inventory.policy_stats(v.policies, v.attachments, v.tenant_ids)


@query(
    "policy_list",
    "SELECT * FROM policies WHERE policy_type = 'service_policy' AND NOT is_shared",
    ["policies"],
)
def _(v):
    return inventory.policy_list(v.policies, "service_policy", "local")


@query(
    "lb_policies",
    """SELECT a.*, CASE WHEN p.name IS NOT NULL THEN p.policy_type || '/' || p.namespace || '/' || p.name END AS policy_id,
  coalesce(p.is_shared, a.policy_namespace = 'shared') AS is_shared
FROM attachments a LEFT JOIN policies p ON a.tenant_id = p.tenant_id AND a.policy_type = p.policy_type
  AND a.policy_namespace = p.namespace AND a.policy_name = p.name""",
    ["policies", "attachments"],
)
def _(v):
    return joins.lb_policies(v.attachments, v.policies)


@query(
    "policy_attached_to",
    """SELECT a.*, p.is_shared FROM attachments a JOIN policies p ON a.tenant_id = p.tenant_id
  AND a.policy_type = p.policy_type AND a.policy_namespace = p.namespace AND a.policy_name = p.name
WHERE EXISTS (SELECT 1 FROM event_lbs l WHERE l.tenant_id = a.tenant_id AND l.namespace = a.lb_namespace
  AND l.name = a.lb_name)""",
    ["policies", "attachments", "event_lbs"],
)
def _(v):
    return joins.policy_attached_to(v.policies, v.attachments, v.event_lbs)


@query(
    "declared_endpoints",
    """SELECT DISTINCT l.tenant_id, l.namespace AS lb_namespace, l.name AS lb_name,
  CASE r % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method,
  '/api/v' || (r % 5) || '/r' || r AS endpoint_path
FROM (SELECT DISTINCT p_partkey % 20 AS r FROM part WHERE p_partkey % 20 < 12) d JOIN event_lbs l ON l.j % 5 = d.r % 5
WHERE l.j < 8""",
    ["event_lbs"],
)
def _(v):
    return joins.declared_endpoints(v.event_attachments, v.api_definitions)


@query(
    "shadow_detection",
    "SELECT tenant_id, lb_namespace, lb_name, method, endpoint_path, is_shadow FROM api_endpoints",
    ["api_endpoints"],
)
def _(v):
    keys = ["tenant_id", "lb_namespace", "lb_name", "method", "endpoint_path", "is_shadow"]
    return v.api_endpoints.select(*keys)


# --- audit ----------------------------------------------------------------------------


def audit(v):
    """Audit records derived from ``orders``."""
    k = F.col("o_orderkey")
    raw = v.table("orders").select(
        k.alias("id"),
        word("t", F.col("o_custkey") % 3).alias("tenant_id"),
        word("user", F.col("o_custkey")).alias("actor_username"),
        F.col("o_orderstatus").alias("event_type"),
        F.repeat(F.col("o_orderpriority"), 60).alias("target"),
        F.lit("success").alias("result"),
        F.when(k % 2 == 0, F.concat(F.lit("10.1.1.1, 10.2.2."), k % 250)).alias("forwarded_for"),
        word("10.3.3.", k % 250).alias("peer"),
        F.lit("").alias("user_agent"),
        F.col("o_orderdate").alias("created_at"),
    )
    return inventory.audit_rows(raw)


AUDIT = """SELECT o_orderkey AS id, 't' || (o_custkey % 3) AS tenant_id, 'user' || o_custkey AS actor_username,
  o_orderstatus AS event_type, repeat(o_orderpriority, 60) AS target, 'success' AS result,
  CASE WHEN o_orderkey % 2 = 0 THEN '10.1.1.1' ELSE '10.3.3.' || (o_orderkey % 250) END AS request_ip,
  CAST(NULL AS VARCHAR) AS user_agent, o_orderdate AS created_at FROM orders"""


@query("audit_rows", AUDIT)
def _(v):
    return audit(v)


@query("audit_tail", f"SELECT * FROM ({AUDIT}) ORDER BY created_at DESC, id LIMIT 50")
def _(v):
    return inventory.audit_tail(audit(v))
