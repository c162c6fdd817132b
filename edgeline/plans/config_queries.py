"""Ingestion of configuration objects and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.plans import payloads as P
from edgeline.plans.registry import query
from edgeline.plans.views import word
from edgeline.sources import config, policies


def load_balancers(v):
    return config.lb_config(P.load_balancer_objects(v))


def sites(v):
    return config.site_config(P.site_objects(v))


LB = """tenant_id, namespace, name, domains, lb_type, advertise_mode, advertised_sites, has_waf, has_service_policy,
  has_bot_defense, has_api_protection, origin_pool_refs, origin_pool_ref_namespaces, cert_ref"""


@query("lb_config", f"SELECT {LB} FROM load_balancers", ["load_balancers"])
def _(v):
    return load_balancers(v).drop("raw_spec")


for _name in ("lb_type", "advertise_mode", "advertised_sites"):

    @query(
        _name,
        f"SELECT {_name}, count(*) AS lbs FROM load_balancers GROUP BY {_name}",
        ["load_balancers"],
    )
    def _(v, name=_name):
        shown = F.col(name)
        if name == "advertised_sites":
            shown = F.array_join(name, ",")
        return load_balancers(v).groupBy(shown.alias(name)).agg(F.count("*").alias("lbs"))


ADDRESS = """CASE s_suppkey % 7 WHEN 0 THEN '10.2.0.' || (s_suppkey % 250) WHEN 1 THEN '10.3.0.' || (s_suppkey % 250)
  WHEN 2 THEN 'p' || (s_suppkey % 250) || '.example.com' WHEN 3 THEN 'q' || (s_suppkey % 250) || '.example.com'
  WHEN 4 THEN 'k8s://svc' || (s_suppkey % 250) WHEN 5 THEN 'consul://con' || (s_suppkey % 250) ELSE 'unknown' END"""


@query(
    "origin_pool_config",
    f"""SELECT 't' || (s_suppkey % 3) AS tenant_id, 'ns' || (s_suppkey % 4) AS namespace, 'pool-' || s_suppkey AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 443 ELSE 80 END AS port, 'LEAST_ACTIVE' AS lb_algorithm, 2 AS origin_count,
  {ADDRESS} || ',10.9.9.9' AS origin_addresses, CASE WHEN s_suppkey % 2 = 0 THEN 'hc-1,hc-2' END AS healthcheck_refs
FROM supplier""",
)
def _(v):
    return config.origin_pool_config(P.pool_objects(v)).drop("raw_spec")


@query(
    "origin_address",
    f"SELECT address, count(*) AS n FROM (SELECT {ADDRESS} AS address FROM supplier) GROUP BY address",
)
def _(v):
    pools = config.origin_pool_config(P.pool_objects(v))
    return pools.groupBy(F.col("origin_addresses")[0].alias("address")).agg(F.count("*").alias("n"))


@query("site_config", "SELECT * FROM sites", ["sites"])
def _(v):
    return sites(v).drop("raw_spec")


@query(
    "certificate_config",
    """SELECT 't' || (o_custkey % 3) AS tenant_id, 'ns' || (o_orderkey % 4) AS namespace, 'cert-' || o_orderkey AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'auto' || o_orderkey WHEN 1 THEN 'CN' || o_custkey END AS subject,
  CASE WHEN o_orderkey % 3 = 1 THEN 'Test CA' END AS issuer,
  CASE WHEN o_orderkey % 3 = 1 THEN 'h' || o_orderkey || '.example.com' ELSE '' END AS san_dns,
  CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate END AS not_before,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL '90 days' WHEN 1 THEN o_orderdate + INTERVAL '30 days' END
    AS not_after,
  CASE WHEN o_orderkey % 3 = 1 THEN printf('%X', o_orderkey) END AS serial_number,
  CAST(NULL AS VARCHAR) AS fingerprint_sha256, o_orderkey % 3 = 0 AS auto_cert FROM orders""",
)
def _(v):
    out = config.certificate_config(P.certificate_objects(v), P.decoded_certificates(v))
    return out.drop("raw_spec")


@query(
    "auto_certificates",
    """SELECT tenant_id, namespace, name || '-auto-cert' AS name, 'CN=' || k AS subject, 'CA' AS issuer, domains AS san_dns,
  CAST(NULL AS TIMESTAMP) AS not_before, TIMESTAMP '2024-03-01' AS not_after, CAST(NULL AS VARCHAR) AS serial_number,
  CAST(NULL AS VARCHAR) AS fingerprint_sha256, true AS auto_cert FROM load_balancers WHERE k % 8 = 0""",
    ["load_balancers"],
)
def _(v):
    return config.auto_certificates(load_balancers(v)).drop("raw_spec")


def health_sites(v):
    """Sites known for half of the site names the health cells use."""
    n = F.col("n_nationkey")
    tenant = F.explode(F.array(*[F.lit(f"t{i}") for i in range(3)]))
    return v.table("nation").select(
        tenant.alias("tenant_id"),
        word("site-", n * 2).alias("name"),
        F.when(n % 2 == 0, "re").otherwise("ce").alias("site_type"),
    )


SITE_KIND = """CASE WHEN CAST(substr(site_name, 6) AS INTEGER) % 4 = 0 THEN 're'
  WHEN CAST(substr(site_name, 6) AS INTEGER) % 2 = 0 THEN 'ce' END AS site_type"""


@query(
    "origin_health_from_raw",
    f"""SELECT tenant_id, pool_id, origin_address, origin_port, site_name,
  CASE WHEN raw_status = 'OFFLINE' THEN 'UNKNOWN' ELSE upper(raw_status) END AS raw_status,
  CASE WHEN raw_status = 'OFFLINE' THEN 'warning' ELSE classified_status END AS classified_status,
  CASE WHEN consecutive_failures > 9 THEN consecutive_failures ELSE 0 END AS consecutive_failures,
  CAST(NULL AS TIMESTAMP) AS last_status_change, last_probe_at, {SITE_KIND} FROM origin_health""",
    ["origin_health"],
)
def _(v):
    return config.origin_health_from_raw(P.health_records(v), health_sites(v))


# --- policies -----------------------------------------------------------------

WHO = """'t' || (c_custkey % 3) AS tenant_id, CASE WHEN c_nationkey = 0 THEN 'shared' ELSE 'ns' || (c_custkey % 3) END
  AS namespace, 'pol-' || c_custkey AS name, c_nationkey = 0 AS is_shared"""


@query(
    "app_firewall_config",
    f"""SELECT {WHO}, CASE c % 3 WHEN 0 THEN 'blocking' WHEN 1 THEN 'monitoring' END AS enforcement_mode,
  CASE WHEN c % 8 = 0 THEN 'zeta' ELSE 'plain' END AS default_anonymization,
  CASE WHEN c % 7 = 0 THEN 'malicious' END AS default_bot_setting,
  CASE c % 5 WHEN 0 THEN 'detection_settings' WHEN 1 THEN 'default_detection_settings' END AS detection_settings,
  array_to_string(list_sort(list_distinct(CASE WHEN c % 5 < 3 THEN ['xss', 'sqli', 'blocking'] ELSE [] END ||
    CASE WHEN c % 11 = 0 THEN ['default_attack_categories'] ELSE [] END)), ',') AS enabled_signature_categories,
  CASE WHEN c % 5 = 2 THEN 'lfi,rfi' ELSE '' END AS blocked_attack_types,
  CASE c % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS custom_rule_count,
  CASE WHEN c % 13 = 0 THEN 2 WHEN c % 5 = 3 THEN 4 ELSE 0 END AS exclusion_rule_count,
  CASE c % 5 WHEN 0 THEN '200,302' WHEN 1 THEN '404,500' END AS allowed_response_codes
FROM (SELECT *, c_custkey AS c FROM customer)""",
)
def _(v):
    return policies.app_firewall_config(P.firewall_objects(v)).drop("raw_spec")


@query(
    "service_policy_config",
    f"""SELECT {WHO}, CASE c % 5 WHEN 0 THEN 'DENY' WHEN 1 THEN 'NEXT_POLICY' WHEN 2 THEN 'CUSTOM_THING' END AS default_action,
  CAST(c % 8 = 1 AS INTEGER) + CAST(c % 3 = 0 AS INTEGER) + CAST(c % 5 = 0 AS INTEGER) + CAST(c % 7 = 0 AS INTEGER)
    + CAST(c % 11 = 0 AS INTEGER) AS rule_count,
  CAST(c % 8 = 1 AS INTEGER) AS allow_rule_count,
  CAST(c % 3 = 0 AS INTEGER) + CAST(c % 5 = 0 AS INTEGER) AS deny_rule_count,
  c % 8 = 1 AS has_geo_rules, c % 3 = 0 AS has_ip_rules, c % 5 = 0 AS has_path_rules
FROM (SELECT *, c_custkey AS c FROM customer)""",
)
def _(v):
    return policies.service_policy_config(P.service_policy_objects(v)).drop("raw_spec")


@query(
    "service_policy_two_specs",
    """SELECT 't' || (c_custkey % 3) AS tenant_id, 'pol-' || c_custkey AS name,
  CASE c_custkey % 3 WHEN 1 THEN 'NEXT' WHEN 2 THEN 'DENY' END AS default_action FROM customer""",
)
def _(v):
    out = policies.service_policy_config(P.two_spec_objects(v))
    return out.select("tenant_id", "name", "default_action")


BOT_PATHS = "CASE WHEN c % 10 = 6 THEN '' WHEN c % 2 = 0 THEN '/a,/b' WHEN c % 3 = 0 THEN '/a' ELSE '' END"


@query(
    "bot_policy_config",
    f"""SELECT {WHO}, CASE WHEN c % 10 <> 6 THEN CAST(c % 2 = 0 AS INTEGER) + CAST(c % 3 = 0 AS INTEGER) + CAST(c % 5 = 0 AS INTEGER)
    + CAST(c % 7 = 0 AS INTEGER) ELSE 0 END AS protected_endpoint_count,
  {BOT_PATHS} AS protected_paths, c % 10 <> 6 AND c % 2 = 0 AS has_javascript_challenge,
  c % 10 <> 6 AND c % 3 = 0 AS has_captcha_challenge, c % 10 <> 6 AND c % 5 = 0 AS has_redirect,
  c % 10 <> 6 AND c % 3 = 0 AS has_block
FROM (SELECT *, c_custkey AS c FROM customer)""",
)
def _(v):
    return policies.bot_policy_config(P.bot_policy_objects(v)).drop("raw_spec")


@query(
    "api_definition_config",
    f"""SELECT {WHO}, CASE WHEN c % 5 = 4 THEN NULL WHEN c % 3 = 0 THEN 'openapi' WHEN c % 8 = 3 THEN 'swagger' END
    AS spec_format,
  CASE WHEN c % 5 = 4 THEN 0 ELSE 1 + CAST(c % 3 = 0 AS INTEGER) + CAST(c % 7 = 0 AS INTEGER) END AS api_specs_count,
  CASE WHEN c % 5 = 4 THEN 0 ELSE 2 * CAST(c % 3 = 0 AS INTEGER) + 2 * CAST(c % 8 = 3 AS INTEGER) END AS endpoint_count,
  (c % 5 <> 4 AND c % 3 = 0) OR c % 11 = 0 AS has_validation_rules,
  CASE WHEN c % 5 = 4 THEN NULL WHEN c % 3 = 0 AND c % 8 = 3 THEN 'DELETE /b,GET /a,PATCH /c,POST /a'
    WHEN c % 3 = 0 THEN 'PATCH /c' WHEN c % 8 = 3 THEN 'DELETE /b,GET /a,POST /a' END AS declared_endpoints
FROM (SELECT *, c_custkey AS c FROM customer)""",
)
def _(v):
    out = policies.api_definition_config(P.api_definition_objects(v)).drop("raw_spec")
    pairs = F.transform("declared_endpoints", lambda e: F.concat_ws(" ", e["method"], e["path"]))
    return out.withColumn("declared_endpoints", F.array_sort(pairs))


@query(
    "inline_bot_policies",
    """SELECT tenant_id, namespace, 'ep-' || (k % 7) AS name, false AS is_shared, 1 AS protected_endpoint_count,
  '/p' || (k % 7) || ',/x' AS protected_paths, k % 2 = 1 AS has_javascript_challenge, false AS has_captcha_challenge,
  false AS has_redirect, k % 2 = 0 AS has_block, name AS lb_name FROM load_balancers WHERE k % 3 = 0 AND k % 9 <> 0""",
    ["load_balancers"],
)
def _(v):
    return policies.inline_bot_policies(load_balancers(v)).drop("raw_spec")


LB_LINKS = """SELECT tenant_id, namespace AS lb_namespace, name AS lb_name, 'app_firewall' AS policy_type,
  'shared' AS policy_namespace, 'fw-' || (k % 5) AS policy_name FROM load_balancers WHERE k % 2 = 0
UNION ALL SELECT tenant_id, namespace, name, 'service_policy', 'shared', 'sp-' || (k % 11) FROM load_balancers WHERE k % 5 = 0
UNION ALL SELECT tenant_id, namespace, name, 'bot_defense_policy', 'shared', 'bp-' || (k % 3) FROM load_balancers
  WHERE k % 9 = 0
UNION ALL SELECT tenant_id, namespace, name, 'bot_defense_policy', namespace, 'ep-' || (k % 7) FROM load_balancers
  WHERE k % 3 = 0 AND k % 9 <> 0
UNION ALL SELECT tenant_id, namespace, name, 'api_definition', 'shared', 'def-' || (k % 6) FROM load_balancers WHERE k % 7 = 0
UNION ALL SELECT tenant_id, namespace, name, 'api_definition', '', 'direct-' || (k % 6) FROM load_balancers WHERE k % 7 = 0"""


@query("policy_attachments_from_lbs", LB_LINKS, ["load_balancers"])
def _(v):
    return policies.policy_attachments_from_lbs(load_balancers(v))


@query(
    "system_policy_filter",
    """SELECT tenant_id, CAST(substr(name, 5) AS BIGINT) AS n FROM policies WHERE name NOT LIKE 'pol-1%'
  AND CAST(substr(name, 5) AS BIGINT) % 50 <> 0""",
    ["policies"],
)
def _(v):
    n = F.substring("name", 5, 20).cast("bigint")
    named = v.policies.withColumn("n", n).withColumn("name", F.when(n % 50 != 0, F.col("name")))
    return policies.system_policy_filter(named, "pol-1").select("tenant_id", "n")


def tenants(v):
    n = F.col("n_nationkey")
    many = F.when(n % 3 == 0, F.array(word("ns", F.col("n_regionkey")), F.lit("shared"))).when(
        n % 3 == 1, F.array().cast("array<string>")
    )
    return v.table("nation").select(
        word("t", n).alias("tenant_id"),
        many.alias("namespaces"),
        word("ns", n % 5).alias("namespace"),
    )


WATCHED = """SELECT 't' || n_nationkey AS tenant_id, unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['ns' || n_regionkey, 'shared']
  ELSE ['ns' || (n_nationkey % 5)] END) AS namespace FROM nation"""


@query("watched_namespaces", WATCHED)
def _(v):
    return config.watched_namespaces(tenants(v))


@query(
    "only_watched",
    f"""SELECT tenant_id, namespace, name FROM load_balancers JOIN (SELECT DISTINCT * FROM ({WATCHED}))
  USING (tenant_id, namespace)""",
    ["load_balancers"],
)
def _(v):
    rows = config.only_watched(load_balancers(v), config.watched_namespaces(tenants(v)))
    return rows.select("tenant_id", "namespace", "name")


@query(
    "all_certificates",
    """SELECT auto_cert, count(*) AS certificates, count(not_after) AS with_expiry FROM (
  SELECT o_orderkey % 3 = 0 AS auto_cert, CASE WHEN o_orderkey % 3 < 2 THEN 1 END AS not_after FROM orders
  UNION ALL SELECT true, 1 FROM load_balancers WHERE k % 8 = 0) GROUP BY auto_cert""",
    ["load_balancers"],
)
def _(v):
    listed = config.certificate_config(P.certificate_objects(v), P.decoded_certificates(v))
    every = config.all_certificates(listed, load_balancers(v))
    return every.groupBy("auto_cert").agg(
        F.count("*").alias("certificates"), F.count("not_after").alias("with_expiry")
    )


@query(
    "all_bot_policies",
    f"""SELECT tenant_id, namespace, name, protected_endpoint_count, protected_paths, has_block FROM (
  SELECT 't' || (c_custkey % 3) AS tenant_id, CASE WHEN c_nationkey = 0 THEN 'shared' ELSE 'ns' || (c_custkey % 3) END
    AS namespace, 'pol-' || c_custkey AS name, CASE WHEN c % 10 <> 6 THEN CAST(c % 2 = 0 AS INTEGER) +
    CAST(c % 3 = 0 AS INTEGER) + CAST(c % 5 = 0 AS INTEGER) + CAST(c % 7 = 0 AS INTEGER) ELSE 0 END AS protected_endpoint_count,
    {BOT_PATHS} AS protected_paths, c % 10 <> 6 AND c % 3 = 0 AS has_block
  FROM (SELECT *, c_custkey AS c FROM customer))
UNION ALL SELECT tenant_id, namespace, 'ep-' || (k % 7), 1, '/p' || (k % 7) || ',/x', k % 2 = 0 FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, namespace, k % 7 ORDER BY name DESC) AS rn FROM load_balancers
  WHERE k % 3 = 0 AND k % 9 <> 0) WHERE rn = 1""",
    ["load_balancers"],
)
def _(v):
    listed = policies.bot_policy_config(P.bot_policy_objects(v))
    every = policies.all_bot_policies(listed, load_balancers(v))
    return every.select(
        "tenant_id", "namespace", "name", "protected_endpoint_count", "protected_paths", "has_block"
    )
