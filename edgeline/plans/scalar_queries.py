"""Each scalar function applied to a column of a whole table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from edgeline.functions import scalars as S
from edgeline.functions.timewin import bucket, within
from edgeline.plans.registry import query
from edgeline.plans.views import AGENTS, nth, word

# raw spelling -> expected value, one pair per row of the check
CATEGORY_CASES = [
    ("Search-Engine Bot", "search_engine"),
    ("  good ", "good_bot"),
    ("BAD", "bad_bot"),
    ("data center bot", "data_center"),
    ("datacenter", "data_center"),
    ("headless-browser", "automation"),
    ("scraping_bot", "scraper"),
    ("Token Missing", "bad_bot"),
    ("MALICIOUS", "bad_bot"),
    ("benign", "good_bot"),
    ("suspicious", "suspicious"),
    ("human", "human"),
    ("", "unknown"),
    ("something else", "unknown"),
]
AUTH_CASES = [
    ("No-Auth", "none"),
    ("jwt", "bearer"),
    (" OAuth 2", "oauth"),
    ("API key", "apikey"),
    ("http_basic", "basic"),
    ("mtls", "unknown"),
    ("bearer", "bearer"),
]
STATE_CASES = [
    ("In_Learning", "learning"),
    (" matured", "mature"),
    ("ACTIVE", "enforcing"),
    ("off", "disabled"),
    ("paused", "unknown"),
    ("enforcing", "enforcing"),
]


def sql_case(index: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values))
    return f"CASE {index} {whens} END"


def _events(v):
    return v.events.withColumnRenamed("event_id", "n")


@query(
    "parse_iso",
    """SELECT event_id AS n, CASE event_id % 7 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL '2 hours' WHEN 2 THEN ts
  WHEN 3 THEN date_trunc('day', ts) END AS parsed FROM events""",
)
def _(v):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    day = F.date_format("ts", "yyyy-MM-dd")
    i = F.col("n") % 7
    text = (
        F.when(i == 0, F.concat(t, F.lit("Z")))
        .when(i == 1, F.concat(t, F.lit("+02:00")))
        .when(i == 2, t)
        .when(i == 3, day)
        .when(i == 4, F.substring(day, 1, 7))
        .when(i == 5, F.lit("not a time"))
        .otherwise(F.lit(""))
    )
    return _events(v).select("n", S.parse_iso(text).alias("parsed"))


@query(
    "parse_asn",
    """SELECT event_id AS n, CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN user_id
  WHEN 3 THEN 4200000000 + user_id END AS asn FROM events""",
)
def _(v):
    u, i = F.col("user_id").cast("string"), F.col("n") % 5
    text = (
        F.when(i == 0, word("Org 7 (", u, ")"))
        .when(i == 1, u)
        .when(i == 2, word("  ", u, " "))
        .when(i == 3, (F.col("user_id") + 4200000000).cast("string"))
        .otherwise(word("AS", u, ".5"))
    )
    return _events(v).select("n", S.parse_asn(text).alias("asn"))


UA_CHAIN = "\n".join(
    f"WHEN regexp_matches(ua, '(?i){p}') THEN '{f}'" for p, f in S.UA_FAMILIES
)


@query(
    "ua_family",
    f"""SELECT event_id AS n, CASE WHEN ua IS NULL OR ua = '' THEN NULL {UA_CHAIN}
  ELSE lower(left(split_part(ua, '/', 1), 64)) END AS family
FROM (SELECT event_id, CASE WHEN k % 17 = 0 THEN '' WHEN k % 17 = 1 THEN 'Tool' || user_id
  ELSE {sql_case("k % 13", AGENTS)} END AS ua FROM ev)""",
    ["ev"],
)
def _(v):
    k = F.col("k")
    ua = (
        F.when(k % 17 == 0, "")
        .when(k % 17 == 1, word("Tool", F.col("user_id")))
        .otherwise(nth(AGENTS, k % 13))
    )
    return _events(v).withColumn("ua", ua).select("n", S.ua_family(F.col("ua")).alias("family"))


def _cases(name, cases, function):
    raws, wants = [a for a, _ in cases], [b for _, b in cases]
    index = f"event_id % {len(cases)}"

    @query(name, f"SELECT event_id AS n, {sql_case(index, wants)} AS value FROM events")
    def _(v):
        raw = nth(raws, F.col("n") % len(cases))
        return _events(v).select("n", function(raw).alias("value"))


_cases("bot_category", CATEGORY_CASES, S.bot_category)
_cases("auth_type", AUTH_CASES, S.auth_type)
_cases("discovery_state", STATE_CASES, S.discovery_state)


@query(
    "confidence_bucket",
    """SELECT event_id AS n, CASE WHEN k % 10 = 0 THEN 'unknown' WHEN floor(value) >= 80 THEN 'high'
  WHEN floor(value) >= 50 THEN 'medium' ELSE 'low' END AS bucket FROM ev""",
    ["ev"],
)
def _(v):
    score = F.when(F.col("k") % 10 != 0, F.floor("value"))
    return _events(v).select("n", S.confidence_bucket(score).alias("bucket"))


@query(
    "normalize_action",
    """SELECT event_id AS n, CASE event_id % 6 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'MONITOR'
    WHEN 3 THEN 'REDIRECT' WHEN 4 THEN 'ALLOW' ELSE 'JS_CHALLENGE' END AS waf,
  CASE event_id % 6 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'MONITOR' WHEN 5 THEN 'CHALLENGE'
    ELSE 'ALLOW' END AS bot FROM events""",
)
def _(v):
    raw = nth(["Blocked", "allowed", "MONITORED", "redirect", "", "js_challenge"], F.col("n") % 6)
    return _events(v).select("n", S.waf_action(raw).alias("waf"), S.bot_action(raw).alias("bot"))


@query(
    "origin_status",
    "SELECT classified_status, raw_status, count(*) AS cells FROM origin_health GROUP BY ALL",
    ["origin_health"],
)
def _(v):
    status = S.origin_status(F.col("raw_status")).alias("classified_status")
    return v.origin_health.groupBy(status, "raw_status").agg(F.count("*").alias("cells"))


@query(
    "site_type_from_name",
    """SELECT n_nationkey AS n, CASE n_nationkey % 3 WHEN 0 THEN 're' WHEN 1 THEN 'unknown' ELSE 're' END AS kind
FROM nation""",
)
def _(v):
    n = F.col("n_nationkey")
    name = F.when(n % 3 == 0, word("ny", n, "-nyc")).when(n % 3 == 1, word("branch_", n))
    name = name.otherwise(word("DAL", n, "-Dal"))
    return v.table("nation").select(n.alias("n"), S.site_type_from_name(name).alias("kind"))


@query(
    "cert_status",
    "SELECT name, d AS days, status FROM cert_status",
    ["cert_status"],
)
def _(v):
    days = S.days_until(F.col("not_after"), v.cert_as_of)
    return v.certificates.select("name", days.alias("days")).withColumn(
        "status", S.cert_status(F.col("days"), 30, 7)
    )


HEX = "md5(CAST(event_id AS VARCHAR))"
DASHED = "substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12)"


@query(
    "stable_event_id",
    f"""SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN {DASHED.format(h="h")} ELSE {DASHED.format(h="s")} END AS id
FROM (SELECT event_id, {HEX} AS h, sha1(CAST(user_id AS VARCHAR) || '|' || event_type || '|' ||
  CASE WHEN event_id % 2 = 0 THEN props ELSE '' END) AS s FROM events)""",
)
def _(v):
    i = F.col("n")
    request = F.when(i % 3 == 0, S.as_uuid(F.md5(i.cast("string").cast("binary")))).when(
        i % 3 == 1, F.lit("not-a-uuid")
    )
    props = F.when(i % 2 == 0, F.col("props"))
    return _events(v).select(
        "n",
        S.stable_event_id(request, F.col("user_id").cast("string"), F.col("event_type"), props).alias(
            "id"
        ),
    )


@query(
    "truncate_text",
    """SELECT doc_id, length(text) AS whole, length(CASE WHEN left(text, 2048) <> '' THEN left(text, 2048) END) AS kept
FROM documents""",
)
def _(v):
    kept = S.truncate_text(F.col("text"), 2048)
    return v.table("documents").select(
        "doc_id", F.char_length("text").cast("bigint").alias("whole"), F.char_length(kept).cast("bigint").alias("kept")
    )


@query(
    "scope",
    """SELECT name, namespace = 'shared' AS is_shared,
  CASE WHEN namespace = 'shared' THEN 'shared' ELSE 'local' END AS scope FROM policies""",
    ["policies"],
)
def _(v):
    ns = F.col("namespace")
    return v.policies.select(
        "name", S.is_shared(ns).alias("is_shared"), S.scope(ns).alias("scope")
    )


@query(
    "bucket_5min",
    """SELECT event_id AS n, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS bucket FROM events""",
)
def _(v):
    return _events(v).select("n", bucket("ts").alias("bucket"))


@query(
    "time_range",
    """SELECT id, event_time FROM waf_events WHERE event_time >= (SELECT s FROM now_) - INTERVAL '36 hours'
  AND event_time <= (SELECT s FROM now_)""",
    ["waf_events", "now_"],
)
def _(v):
    rows = within(v.waf_events, "event_time", v.as_of, timedelta(hours=36))
    return rows.select("id", "event_time")


@query(
    "client_ip_from_forwarded",
    """SELECT event_id AS n, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '10.9.9.9'
  WHEN 2 THEN '10.0.0.' || user_id END AS ip FROM events""",
)
def _(v):
    i, ip = F.col("n") % 4, word("10.0.0.", F.col("user_id"))
    forwarded = (
        F.when(i == 0, F.concat(F.lit(" "), ip, F.lit(" , 172.16.0.1, 10.1.1.1")))
        .when(i == 1, "")
        .when(i == 2, ip)
        .otherwise(" ,1.2.3.4")
    )
    out = S.client_ip_from_forwarded(forwarded, F.lit("10.9.9.9"))
    return _events(v).select("n", out.alias("ip"))
