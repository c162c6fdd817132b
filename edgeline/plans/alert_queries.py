"""Alert rules, the alert merge and alert reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.functions import paging
from edgeline.operators import alerts, inventory, joins, merge
from edgeline.plans.ctes import pct, rnd
from edgeline.plans.registry import query
from edgeline.plans.views import nth, word


def order_alerts(v):
    """Alerts derived from ``orders``: one per order, status from the order status."""
    k, o = F.col("o_orderkey"), F.col("o_orderstatus")
    day = F.col("o_orderdate")

    def after(days: int):
        return day + F.expr(f"INTERVAL {days} DAYS")

    return v.table("orders").select(
        word("t", F.col("o_custkey") % 3).alias("tenant_id"),
        word("rule-", k % 6).alias("rule_id"),
        word("key:", k).alias("dedupe_key"),
        nth(["critical", "warning", "info"], k % 3).alias("severity"),
        F.when(o == "O", "open").when(o == "P", "acknowledged").otherwise("resolved").alias("status"),
        word("Order ", k).alias("title"),
        F.col("o_orderpriority").alias("description"),
        F.lit("{}").alias("context"),
        F.lit(1).cast("bigint").alias("occurrence_count"),
        day.alias("first_seen_at"),
        after(1).alias("last_seen_at"),
        F.when(o != "O", after(2)).alias("acknowledged_at"),
        F.when(o == "F", after(10)).alias("resolved_at"),
    )


ALERTS = """SELECT 't' || (o_custkey % 3) AS tenant_id, 'rule-' || (o_orderkey % 6) AS rule_id,
  'key:' || o_orderkey AS dedupe_key,
  CASE o_orderkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'acknowledged' ELSE 'resolved' END AS status,
  'Order ' || o_orderkey AS title, o_orderpriority AS description, '{}' AS context, 1 AS occurrence_count,
  o_orderdate AS first_seen_at, o_orderdate + INTERVAL '1 day' AS last_seen_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '2 days' END AS acknowledged_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '10 days' END AS resolved_at, o_orderkey, o_orderdate
FROM orders"""
ALERT = """tenant_id, rule_id, dedupe_key, severity, status, title, description, context, occurrence_count, first_seen_at,
  last_seen_at, acknowledged_at, resolved_at"""

# --- rules --------------------------------------------------------------------------

# low thresholds and long windows: the test tables hold about four events a minute
BURST = dict(threshold=1, minutes=24 * 60)
STUFFING = dict(min_events=3, failure_pct=30.0, minutes=7 * 24 * 60)
SHADOW = dict(min_samples=50)
STATE = dict(poll_seconds=600)

BURST_SQL = """SELECT tenant_id, 'waf.block_burst' AS rule_id, 'warning' AS severity,
  'lb:' || lb_namespace || '/' || lb_name AS dedupe_key, 'Blocks spike at ' || lb_name AS title,
  lb_name || ': ' || peak || ' blocked requests in the worst of 1440 minutes, limit 1' AS description,
  json_object('lb_namespace', lb_namespace, 'lb_name', lb_name, 'peak_blocks_per_min', peak, 'threshold', 1)::VARCHAR
    AS context, 0 AS ord
FROM (SELECT tenant_id, lb_namespace, lb_name, max(blocked_count) AS peak FROM waf_metrics
  WHERE bucket_time >= (SELECT t FROM now_) - INTERVAL '24 hours' AND bucket_time <= (SELECT t FROM now_)
  GROUP BY ALL HAVING max(blocked_count) >= 1)"""
NEW_SQL = """SELECT tenant_id, 'waf.new_attacker' AS rule_id, 'info' AS severity, 'ip:' || source_ip AS dedupe_key,
  'First blocks from ' || source_ip AS title,
  source_ip || ' [' || coalesce(source_country, 'unknown') || ', ASN ' || coalesce(CAST(source_asn AS VARCHAR), '?') ||
    '] had ' || n || ' requests blocked within the hour and none in the day before' AS description,
  json_object('source_ip', source_ip, 'source_country', source_country, 'source_asn', source_asn, 'block_count', n)::VARCHAR
    AS context, rn AS ord
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, source_ip) AS rn FROM (
  SELECT tenant_id, source_ip, source_country, source_asn, count(*) AS n FROM waf_events WHERE action = 'BLOCK'
    AND source_ip IS NOT NULL AND event_time >= (SELECT t FROM now_) - INTERVAL '1 hour' GROUP BY ALL)) r
WHERE rn <= 10 AND NOT EXISTS (SELECT 1 FROM waf_events p WHERE p.tenant_id = r.tenant_id AND p.source_ip = r.source_ip
  AND p.action = 'BLOCK' AND p.event_time >= (SELECT t FROM now_) - INTERVAL '25 hours'
  AND p.event_time < (SELECT t FROM now_) - INTERVAL '1 hour')"""
STUFFING_SQL = f"""SELECT tenant_id, 'bot.cred_stuffing' AS rule_id, 'critical' AS severity, 'ip:' || source_ip AS dedupe_key,
  'Failed bot challenges pile up for ' || source_ip AS title,
  failed || ' of ' || total || ' challenges failed, ' || CAST({rnd("failed::DOUBLE / total * 100.0", 0)} AS BIGINT) ||
    ' % within 10080 minutes, country ' || coalesce(source_country, 'unknown') AS description,
  json_object('source_ip', source_ip, 'source_country', source_country, 'source_asn', source_asn, 'total_attempts', total,
    'failed_challenges', failed, 'failure_pct', {pct("failed", "total", 1)}, 'endpoint_sample', ep)::VARCHAR AS context,
  0 AS ord
FROM (SELECT tenant_id, source_ip, source_country, source_asn, count(*) AS total,
  count(*) FILTER (challenge_result = 'failed') AS failed, max(endpoint_path) AS ep FROM bot_events
  WHERE event_time >= (SELECT t FROM now_) - INTERVAL '168 hours' AND source_ip IS NOT NULL
    AND action IN ('CHALLENGE', 'BLOCK') GROUP BY ALL HAVING count(*) >= 3)
WHERE failed * 100.0 >= total * 30.0"""
STATE_SQL = """SELECT tenant_id, 'api.state_change' AS rule_id, 'info' AS severity,
  'lb:' || lb_namespace || '/' || lb_name || ':' || state AS dedupe_key,
  lb_name || ' is now ' || state AS title,
  'Learning at ' || lb_name || ' became ' || state || ', confidence ' ||
    coalesce(CAST(confidence_score AS VARCHAR), '?') || ', known endpoints ' || total_endpoints_discovered AS description,
  json_object('lb_namespace', lb_namespace, 'lb_name', lb_name, 'state', state, 'confidence_score', confidence_score,
    'endpoints', total_endpoints_discovered)::VARCHAR AS context, 0 AS ord
FROM states WHERE state_changed_at >= (SELECT t FROM now_) - INTERVAL '660 seconds'"""
SHADOW_SQL = """SELECT tenant_id, 'api.shadow_emergence' AS rule_id, 'warning' AS severity,
  'ep:' || lb_name || ':' || method || ':' || endpoint_path AS dedupe_key,
  'Undeclared endpoint in use: ' || method || ' ' || endpoint_path AS title,
  lb_name || ' served ' || total_request_samples || ' requests for ' || method || ' ' || endpoint_path ||
    ', which no definition declares; authentication ' || coalesce(auth_type, 'unknown') AS description,
  json_object('endpoint_id', lb_namespace || '/' || lb_name || '/' || method || '/' || endpoint_path, 'lb_name', lb_name,
    'method', method, 'path', endpoint_path, 'samples', total_request_samples, 'auth_type', auth_type)::VARCHAR AS context,
  0 AS ord
FROM api_endpoints WHERE is_shadow AND total_request_samples >= 50
  AND first_seen_at >= TIMESTAMP '2024-01-02' - INTERVAL '24 hours'
  AND first_seen_at <= TIMESTAMP '2024-02-02'"""
CERT_SQL = """SELECT tenant_id, 'cert.expiry' AS rule_id, CASE WHEN d <= 1 THEN 'critical' ELSE 'warning' END AS severity,
  'cert:' || namespace || ':' || name AS dedupe_key,
  name || CASE WHEN d < 0 THEN ' has expired' ELSE ' runs out soon' END AS title,
  namespace || '/' || name || CASE WHEN d < 0 THEN ': over for ' || abs(d) || ' days' ELSE ': days left ' || d END
    AS description,
  json_object('namespace', namespace, 'name', name, 'not_after', strftime(not_after, '%Y-%m-%dT%H:%M:%S') || '+00:00',
    'days_until_expiry', d)::VARCHAR AS context, 0 AS ord
FROM cert_status WHERE not_after <= TIMESTAMP '1998-06-01' + INTERVAL '7 days'"""

RULE_SQL = {
    "waf.block_burst": (BURST_SQL, ["waf_metrics", "now_"]),
    "waf.new_attacker": (NEW_SQL, ["waf_events", "now_"]),
    "bot.cred_stuffing": (STUFFING_SQL, ["bot_events", "now_"]),
    "api.state_change": (STATE_SQL, ["states", "now_"]),
    "api.shadow_emergence": (SHADOW_SQL, ["api_endpoints"]),
    "cert.expiry": (CERT_SQL, ["cert_status"]),
}


@query("rule_waf_block_burst", *RULE_SQL["waf.block_burst"])
def _(v):
    return alerts.waf_block_burst(v.waf_metrics, as_of=v.as_of, **BURST)


@query("rule_waf_new_attacker", *RULE_SQL["waf.new_attacker"])
def _(v):
    return alerts.waf_new_attacker(v.waf_events, as_of=v.as_of)


@query("rule_bot_cred_stuffing", *RULE_SQL["bot.cred_stuffing"])
def _(v):
    return alerts.bot_cred_stuffing(v.bot_events, as_of=v.as_of, **STUFFING)


@query("rule_api_state_change", *RULE_SQL["api.state_change"])
def _(v):
    return alerts.api_state_change(v.states, as_of=v.as_of, **STATE)


def early(v):
    """A moment just after the first endpoints appeared."""
    return F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")


@query(
    "rule_api_shadow_emergence",
    SHADOW_SQL.replace("TIMESTAMP '2024-02-02'", "TIMESTAMP '2024-01-02'"),
    ["api_endpoints"],
)
def _(v):
    return alerts.api_shadow_emergence(v.api_endpoints, as_of=early(v), **SHADOW)


@query("rule_cert_expiry", *RULE_SQL["cert.expiry"])
def _(v):
    return alerts.cert_expiry(v.certificates, as_of=v.cert_as_of)


@query(
    "new_vs_prior",
    """SELECT DISTINCT tenant_id, source_ip FROM waf_events e WHERE action = 'BLOCK' AND source_ip IS NOT NULL
  AND event_time >= (SELECT t FROM now_) - INTERVAL '24 hours' AND NOT EXISTS (SELECT 1 FROM waf_events p
    WHERE p.tenant_id = e.tenant_id AND p.source_ip = e.source_ip AND p.action = 'BLOCK'
    AND p.event_time < (SELECT t FROM now_) - INTERVAL '24 hours' AND p.event_time >= (SELECT t FROM now_) - INTERVAL '72 hours')""",
    ["waf_events", "now_"],
)
def _(v):
    key = ["tenant_id", "source_ip"]
    blocks = v.waf_events.filter((F.col("action") == "BLOCK") & F.col("source_ip").isNotNull())
    day, three = v.as_of - F.expr("INTERVAL 24 HOURS"), v.as_of - F.expr("INTERVAL 72 HOURS")
    recent = blocks.filter(F.col("event_time") >= day).select(*key).distinct()
    prior = blocks.filter((F.col("event_time") < day) & (F.col("event_time") >= three))
    return joins.new_vs_prior(recent, prior, key)


def tables(v):
    return alerts.Tables(
        waf_metrics=v.waf_metrics,
        waf_events=v.waf_events,
        bot_events=v.bot_events,
        states=v.states,
        endpoints=v.api_endpoints,
        # the certificates belong to another period: shift them to the events' clock
        certificates=v.certificates.withColumn(
            "not_after", F.col("not_after") + (F.lit("2024-01-31").cast("timestamp_ntz") - v.cert_as_of)
        ),
    )


RULES = alerts.RuleSettings(
    arguments={"waf.block_burst": BURST, "bot.cred_stuffing": STUFFING, "api.shadow_emergence": SHADOW}
)


def cte(sql: str) -> str:
    return f"SELECT * FROM ({sql})"


SHADOW_NOW = SHADOW_SQL.replace(
    "first_seen_at >= TIMESTAMP '2024-01-02' - INTERVAL '24 hours'",
    "first_seen_at >= (SELECT t FROM now_) - INTERVAL '24 hours'",
).replace("first_seen_at <= TIMESTAMP '2024-02-02'", "first_seen_at <= (SELECT t FROM now_)")
CERT_NOW = (
    CERT_SQL.replace("FROM cert_status", "FROM shifted")
    .replace("TIMESTAMP '1998-06-01'", "(SELECT t FROM now_)")
)
SHIFTED = """shifted AS (SELECT * EXCLUDE (not_after), not_after, CAST(floor((epoch_us(not_after) -
    epoch_us((SELECT t FROM now_))) / 86400000000.0) AS INTEGER) AS d FROM (SELECT * EXCLUDE (not_after),
    not_after + (TIMESTAMP '2024-01-31' - TIMESTAMP '1998-06-01') AS not_after FROM certificates))"""
ALL_RULES = " UNION ALL ".join(
    cte(s) for s in (BURST_SQL, NEW_SQL, STUFFING_SQL, STATE_SQL, SHADOW_NOW, CERT_NOW)
)
RULE_VIEWS = [
    "waf_metrics",
    "waf_events",
    "bot_events",
    "states",
    "api_endpoints",
    "certificates",
    "now_",
]


@query(
    "evaluate_rules",
    f"WITH {SHIFTED} SELECT rule_id, severity, count(*) AS candidates FROM ({ALL_RULES}) GROUP BY ALL",
    RULE_VIEWS,
)
def _(v):
    found, failed = alerts.evaluate_rules(tables(v), v.as_of, RULES)
    assert not failed, failed
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("candidates"))


# --- merge and transitions ---------------------------------------------------------------

FIRED = """SELECT tenant_id, rule_id, dedupe_key, n, 'critical' AS severity, 'again ' || dedupe_key AS title FROM (
  SELECT tenant_id, rule_id, dedupe_key, CASE WHEN severity = 'info' THEN 1 ELSE 2 END AS n FROM a WHERE severity <> 'critical'
  UNION ALL SELECT tenant_id, rule_id, 'new:' || dedupe_key, 1 FROM a WHERE severity = 'info')"""


@query(
    "alert_merge",
    f"""WITH a AS ({ALERTS}), f AS ({FIRED})
SELECT tenant_id, rule_id, dedupe_key, coalesce(f.severity, a.severity) AS severity, coalesce(a.status, 'open') AS status,
  coalesce(f.title, a.title) AS title, CASE WHEN n IS NULL THEN a.description ELSE 'd' END AS description,
  CASE WHEN n IS NULL THEN a.context ELSE '{{"x":1}}' END AS context,
  CAST(coalesce(a.occurrence_count, 0) + coalesce(n, 0) AS BIGINT) AS occurrence_count,
  coalesce(a.first_seen_at, TIMESTAMP '1998-06-01') AS first_seen_at,
  CASE WHEN n IS NULL THEN a.last_seen_at ELSE TIMESTAMP '1998-06-01' END AS last_seen_at, a.acknowledged_at, a.resolved_at
FROM a FULL JOIN f USING (tenant_id, rule_id, dedupe_key)""",
)
def _(v):
    stored = order_alerts(v)
    again = stored.filter("severity <> 'critical'")
    copies = F.when(F.col("severity") == "info", 1).otherwise(2)
    repeated = again.withColumn("ord", F.explode(F.sequence(F.lit(1), copies)))
    new = stored.filter("severity = 'info'").withColumn("ord", F.lit(1))
    rows = repeated.unionByName(new.withColumn("dedupe_key", F.concat(F.lit("new:"), "dedupe_key")))
    candidates = rows.select(
        *merge.ALERT_KEYS,
        F.lit("critical").alias("severity"),
        F.concat(F.lit("again "), "dedupe_key").alias("title"),
        F.lit("d").alias("description"),
        F.lit('{"x":1}').alias("context"),
        F.col("ord").cast("bigint").alias("ord"),
    )
    times = ["first_seen_at", "last_seen_at", "acknowledged_at", "resolved_at"]
    typed = stored.select(
        *[F.col(c).cast("timestamp").alias(c) if c in times else c for c in stored.columns]
    )
    return merge.alert_merge(typed, candidates, v.cert_as_of)


@query(
    "alert_transition",
    f"""WITH a AS ({ALERTS})
SELECT tenant_id, rule_id, dedupe_key,
  CASE o_orderkey % 5 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'resolved' WHEN 2 THEN 'open' WHEN 3 THEN 'resolved'
    ELSE status END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN coalesce(acknowledged_at, o_orderdate + INTERVAL '20 days')
    WHEN 1 THEN coalesce(acknowledged_at, o_orderdate + INTERVAL '20 days') WHEN 2 THEN NULL
    WHEN 3 THEN o_orderdate + INTERVAL '22 days' ELSE acknowledged_at END AS acknowledged_at,
  CASE o_orderkey % 5 WHEN 0 THEN resolved_at WHEN 1 THEN o_orderdate + INTERVAL '21 days' WHEN 2 THEN NULL
    WHEN 3 THEN o_orderdate + INTERVAL '23 days' ELSE resolved_at END AS resolved_at FROM a""",
)
def _(v):
    # 0: acknowledge; 1: acknowledge, resolve; 2: resolve, reopen;
    # 3: resolve, reopen, acknowledge, resolve; 4: nothing
    k = F.substring("dedupe_key", 5, 20).cast("bigint") % 5
    plan = [
        ["acknowledge"],
        ["acknowledge", "resolve"],
        ["resolve", "reopen"],
        ["resolve", "reopen", "acknowledge", "resolve"],
    ]
    steps = F.coalesce(
        *[F.when(k == i, F.array(*[F.lit(x) for x in p])) for i, p in enumerate(plan)]
    )
    stored = order_alerts(v)
    actions = stored.select(
        *merge.ALERT_KEYS, "first_seen_at", F.posexplode(steps).alias("i", "action")
    ).select(
        *merge.ALERT_KEYS,
        "action",
        (F.col("first_seen_at") + F.make_dt_interval(F.lit(20) + F.col("i"))).alias("at"),
    )
    out = merge.alert_transition(stored, actions)
    return out.select(*merge.ALERT_KEYS, "status", "acknowledged_at", "resolved_at")


# --- reads -----------------------------------------------------------------------------


@query(
    "alert_summary",
    f"""SELECT tenant_id, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'acknowledged') AS acknowledged,
  count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'open' AND severity = 'critical') AS critical,
  count(*) FILTER (status = 'open' AND severity = 'warning') AS warning,
  count(*) FILTER (status = 'open' AND severity = 'info') AS info FROM ({ALERTS}) GROUP BY tenant_id""",
)
def _(v):
    return alerts.alert_summary(order_alerts(v))


@query(
    "alert_list",
    f"""SELECT {ALERT} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY last_seen_at DESC NULLS FIRST, rule_id,
  dedupe_key) AS rn FROM ({ALERTS}) WHERE status = 'open' AND severity = 'warning') WHERE rn > 10 AND rn <= 210""",
)
def _(v):
    return alerts.alert_list(order_alerts(v), severity="warning", offset=10)


@query(
    "alert_list_next",
    f"""SELECT {ALERT} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY last_seen_at DESC NULLS FIRST, rule_id,
  dedupe_key) AS rn FROM ({ALERTS}) WHERE status = 'open') WHERE rn > 200 AND rn <= 400""",
)
def _(v):
    rows = order_alerts(v)
    seen = paging.cursors(alerts.alert_list(rows), ["tenant_id"], alerts.ALERT_KEYS)
    return alerts.alert_list(rows, after=seen)


@query(
    "alert_list_by_rule",
    f"""SELECT {ALERT} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY last_seen_at DESC NULLS FIRST, rule_id,
  dedupe_key) AS rn FROM ({ALERTS}) WHERE rule_id = 'rule-2') WHERE rn <= 2000""",
)
def _(v):
    return alerts.alert_list(order_alerts(v), status="all", rule_id="rule-2", limit=2000)


@query(
    "alert_detail",
    f"SELECT {ALERT} FROM ({ALERTS}) WHERE rule_id = 'rule-2' AND dedupe_key = 'key:8'",
)
def _(v):
    return inventory.detail(order_alerts(v), rule_id="rule-2", dedupe_key="key:8")
