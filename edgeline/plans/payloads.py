"""Raw JSON records built from the typed views, under the field names live feeds use.

The checks never read these payloads: DuckDB computes the expected rows from the
columns, so the parsers are tested against an independent path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import scalars as S
from edgeline.plans.views import Views, nth, word
from edgeline.sources.metrics import API_COUNTS, API_LATENCIES, BOT_SERIES, WAF_SERIES

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
KEYS = ["tenant_id", "lb_namespace", "lb_name"]


def landed(minute: int = 0) -> Column:
    """When a record arrived."""
    return F.lit(f"2024-03-01 00:{minute:02d}:00").cast("timestamp").alias("landed_at")


def iso(c: str | Column) -> Column:
    return F.date_format(c, ISO)


def record(**fields: Column) -> Column:
    """JSON object without the null members."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def damaged(payload: Column) -> Column:
    """Every 97th record is cut off in the middle."""
    return F.when(F.col("event_id") % 97 == 0, F.substring(payload, 1, 20)).otherwise(payload)


def wrapped(payload: Column) -> Column:
    """Every 11th record arrives as a JSON string that holds the JSON text."""
    quoted = F.replace(F.replace(payload, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(
        F.col("event_id") % 11 == 0, F.concat(F.lit('"'), quoted, F.lit('"'))
    ).otherwise(payload)


def request_id() -> Column:
    digest = F.md5(F.col("event_id").cast("string").cast("binary"))
    return F.when(F.col("event_id") % 2 == 0, S.as_uuid(digest))


def security_records(v: Views) -> DataFrame:
    """Firewall events as raw records."""
    m = F.col("event_id") % 4
    t, asn = iso("event_time"), F.col("source_asn")
    sig = F.col("primary_signature")
    past = F.concat(F.lower("action"), F.lit("ed"))
    silent = (m == 3) & (F.col("action") == "ALLOW")
    spelled = F.when(m % 2 == 0, past).when(~silent, F.col("action"))
    as_object = F.to_json(F.struct(F.lit("shared").alias("namespace"), word("fw-", F.col("k") % 3).alias("name")))
    policy = F.when(m == 0, as_object).when(m == 1, '"inline"').when(m == 2, "{}")
    body = record(
        **{
            "@timestamp": F.when(m == 0, t),
            "event_time": F.when(m == 1, t),
            "timestamp": F.when(m == 2, t),
            "time": F.when(m == 3, t),
            "action": spelled,
            "src_ip": F.when(m % 2 == 0, F.col("source_ip")),
            "source_ip": F.when(m % 2 == 1, F.col("source_ip")),
            "country": F.when(m == 0, F.col("source_country")),
            "src_country": F.when(m == 1, F.col("source_country")),
            "source_country": F.when(m >= 2, F.col("source_country")),
            "asn": F.when((m == 0) & asn.isNotNull(), word("Org X (", asn, ")")).when(m == 3, ""),
            "src_asn": F.when(m % 2 == 1, asn),
            "source_asn": F.when(m == 2, asn.cast("string")),
            "method": F.col("method"),
            "req_path": F.when(m % 2 == 0, F.col("url")),
            "url": F.when(m % 2 == 1, F.col("url")),
            "rsp_code": F.when(m % 2 == 0, F.col("response_code")),
            "response_code": F.when(m % 2 == 1, F.col("response_code").cast("string")),
            "sec_event_name": F.when(m <= 1, sig),
            "violation_name": F.when(m == 2, sig),
            "primary_signature": F.when(m == 3, sig),
            "severity": F.col("severity"),
            "violation_ids": F.when(
                F.col("k") % 3 == 0, F.array(word("V", F.col("k") % 5))
            ),
            "req_id": request_id(),
            "vh_name": word("vh-", F.col("k") % 10),
        }
    )
    # waf_policy is an object, a string or empty: spliced in as JSON text
    spliced = F.when(
        policy.isNotNull(),
        F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"waf_policy":'), policy, F.lit("}")),
    ).otherwise(F.col("body"))
    rows = v.waf_events.withColumn("body", body).withColumn("body", spliced)
    return rows.select("event_id", *KEYS, wrapped(damaged(F.col("body"))).alias("payload"))


def long_path_records(v: Views) -> DataFrame:
    """Firewall events whose paths differ only behind 3,000 equal characters."""
    path = F.concat(F.lit("/" + "x" * 3000), F.col("url"))
    body = record(time=iso("event_time"), method=F.col("method"), url=path)
    return v.waf_events.select(*KEYS, body.alias("payload"))


def standard_bot_records(v: Views) -> DataFrame:
    """Bot events in the shared security feed; a third of the records are not bot events."""
    n = F.col("event_id") % 3
    score, category = F.col("confidence_score"), F.col("raw_category")
    inner = F.struct(
        F.col("raw_action").alias("action"),
        category.alias("automation_type"),
        score.cast("string").alias("bot_score"),
        F.struct(F.lit("js").alias("type"), F.col("raw_result").alias("result")).alias("challenge"),
        F.struct(F.lit("shared").alias("namespace"), word("bp-", F.col("k") % 4).alias("name")).alias(
            "policy"
        ),
    )
    body = record(
        **{
            "@timestamp": iso("event_time"),
            "sec_event_type": F.when(n == 0, "bot_defense_sec_event").otherwise("waf_sec_event"),
            "sec_event_name": F.lit("Bot Defense Violation"),
            "action": F.when(n != 1, F.col("raw_action")),
            "bot_classification": F.when(n == 0, category),
            "bot_score": F.when(n == 0, score),
            "bot_defense": F.when(n == 1, inner),
            "src_ip": F.col("source_ip"),
            "country": F.col("source_country"),
            "asn": F.col("source_asn"),
            "method": F.col("method"),
            "req_path": F.col("endpoint_path"),
            "user_agent": F.col("user_agent"),
            "req_id": request_id(),
        }
    )
    return v.bot_raw.select("event_id", *KEYS, damaged(body).alias("payload"))


def advanced_bot_records(v: Views) -> DataFrame:
    """Bot events of the dedicated feed, in two spellings."""
    n = F.col("event_id") % 2
    score, category = F.col("confidence_score"), F.col("raw_category")
    body = record(
        event_time=iso("event_time"),
        action=F.col("raw_action"),
        bot_category=F.when(n == 0, category),
        classification=F.when(n == 1, category),
        confidence_score=F.when(n == 0, score).otherwise(F.lit(0)),
        bot_score=F.when(n == 1, score.cast("string")),
        challenge=F.when(
            n == 0, F.struct(F.lit("js").alias("type"), F.col("raw_result").alias("result"))
        ),
        challenge_type=F.when(n == 1, "captcha"),
        challenge_result=F.when(n == 1, F.coalesce(F.col("raw_result"), F.lit("strange"))),
        device_anomalies=F.when(n == 0, F.array(word("a", F.col("k") % 3), F.lit("b"))),
        device_fingerprint_anomalies=F.when(n == 1, "x"),
        bot_policy=F.when(
            n == 0,
            F.struct(F.lit("shared").alias("namespace"), word("bp-", F.col("k") % 4).alias("name")),
        ),
        source_ip=F.col("source_ip"),
        source_country=F.col("source_country"),
        source_asn=F.col("source_asn"),
        method=F.col("method"),
        url=F.when(n == 0, F.col("endpoint_path")),
        endpoint=F.when(n == 1, F.col("endpoint_path")),
        user_agent=F.col("user_agent"),
        request_id=request_id(),
    )
    return v.bot_raw.select("event_id", *KEYS, damaged(body).alias("payload"))


# --- metric documents ---------------------------------------------------------

BAD_CELLS = ',["nope",1],["2024-01-01T00:00:00Z","x"],7,["2024-01-01T00:00:00Z"],["2024-01-01T00:00:00Z",null]'


def _cell(value: Column) -> Column:
    """``["<time>", value]``; every fifth minute the number arrives as text."""
    as_text = F.minute("bucket_time") % 5 == 0
    n = F.coalesce(value.cast("string"), F.lit("null"))
    shown = F.when(as_text & value.isNotNull(), F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n)
    return F.concat(F.lit('["'), iso("bucket_time"), F.lit('",'), shown, F.lit("]"))


def _series_text(metric: str, cells: str, labels: Column | None = None, bad: str = "") -> Column:
    parts = [F.lit('{"metric":"' + metric + '",')]
    if labels is not None:
        parts += [F.lit('"labels":'), labels, F.lit(",")]
    parts += [F.lit('"values":['), F.concat_ws(",", cells), F.lit(bad + "]}")]
    return F.concat(*parts)


def waf_metric_documents(v: Views) -> DataFrame:
    """One document per load balancer and day; even days as series, odd days flat."""
    names = WAF_SERIES
    flat = record(
        by_site=F.struct(F.lit(3).alias("request_count"), F.lit("4").alias("error_count")),
        bucket_time=iso("bucket_time"),
        request_count=F.col("request_count"),
        waf_blocked_count=F.col("blocked_count"),
        waf_monitored_count=F.col("monitored_count").cast("string"),
        error_count=F.col("error_count"),
    )
    docs = v.waf_metrics.groupBy(*KEYS, F.to_date("bucket_time").alias("day")).agg(
        *[F.collect_list(_cell(F.col(c))).alias(f"s_{c}") for c in names.values()],
        F.collect_list(flat).alias("flat"),
    )
    series = F.concat_ws(
        ",",
        *[_series_text(m, f"s_{c}", bad=BAD_CELLS) for m, c in names.items()],
        F.lit('{"metric":"loadbalancer.other","values":[["2024-01-01T00:00:00Z",5]]}'),
        F.lit("3"),
    )
    flats = F.concat(F.concat_ws(",", "flat"), F.lit(',{"bucket_time":"bad","request_count":1}'))
    data = F.when(F.day("day") % 2 == 0, series).otherwise(flats)
    return docs.select(
        *KEYS, landed(), F.concat(F.lit('{"step":"60s","data":['), data, F.lit("]}")).alias("payload")
    )


def corrected_waf_documents(v: Views) -> DataFrame:
    """Per load balancer and day a first document, and one landed later with fewer requests a minute."""

    def documents(minute: int, count: Column) -> DataFrame:
        cells = F.concat(F.lit('["'), iso("bucket_time"), F.lit('",'), count.cast("string"), F.lit("]"))
        docs = v.waf_metrics.groupBy(*KEYS, F.to_date("bucket_time").alias("day")).agg(F.collect_list(cells).alias("cells"))
        text = F.concat(F.lit('{"data":['), _series_text("loadbalancer.request_count", "cells"), F.lit("]}"))
        return docs.select(*KEYS, landed(minute), text.alias("payload"))

    n = F.col("request_count")
    return documents(9, n).unionByName(documents(5, n + 1000))


def bot_metric_documents(v: Views) -> DataFrame:
    names = BOT_SERIES
    docs = v.bot_metrics.groupBy(*KEYS, F.to_date("bucket_time").alias("day")).agg(
        *[F.collect_list(_cell(F.col(c))).alias(f"s_{c}") for c in names.values()]
    )
    series = F.concat_ws(",", *[_series_text(m, f"s_{c}", bad=BAD_CELLS) for m, c in names.items()])
    return docs.select(*KEYS, landed(), F.concat(F.lit('{"data":['), series, F.lit("]}")).alias("payload"))


def api_metric_documents(v: Views) -> DataFrame:
    """One document per endpoint and day, six labelled series each."""
    names = {**API_COUNTS, **API_LATENCIES}
    day = F.to_date("bucket_time").alias("day")
    docs = v.api_metrics.groupBy(*KEYS, "method", "endpoint_path", day).agg(
        *[F.collect_list(_cell(F.col(c))).alias(f"s_{c}") for c in names.values()]
    )
    odd = F.day("day") % 2 == 1
    labels = record(
        method=F.concat(F.lit(" "), F.lower("method")),
        endpoint=F.when(odd, F.col("endpoint_path")),
        path=F.when(~odd, F.concat(F.col("endpoint_path"), F.lit(" "))),
    )
    series = F.concat_ws(",", *[_series_text(m, f"s_{c}", labels) for m, c in names.items()])
    unlabelled = F.lit(',{"metric":"loadbalancer.request_count","labels":{},"values":[["2024-01-01T00:00:00Z",5]]}')
    return docs.select(
        *KEYS, landed(), F.concat(F.lit('{"data":['), series, unlabelled, F.lit("]}")).alias("payload")
    )


# --- API discovery ---------------------------------------------------------------


def endpoint_records(v: Views) -> DataFrame:
    """Discovered endpoints; spellings vary by the length of the path."""
    odd = F.char_length("endpoint_path") % 2 == 1
    n = F.col("total_request_samples")
    body = record(
        method=F.when(odd, F.concat(F.lower("method"), F.lit(" "))),
        http_method=F.when(~odd, F.col("method")),
        path=F.when(odd, F.col("endpoint_path")),
        endpoint=F.when(~odd, F.concat(F.lit(" "), F.col("endpoint_path"))),
        discovery_confidence=F.when(odd, n % 101),
        confidence=F.when(~odd, (n % 101).cast("string")),
        total_request_samples=F.when(odd, n.cast("string")).otherwise("many"),
        last_seen=F.when(odd, iso("last_seen_at")),
        last_seen_at=F.when(~odd, iso("last_seen_at")),
        first_seen=iso("first_seen_at"),
        response_codes=F.when(odd, F.col("response_codes").cast("array<string>")).otherwise(
            F.array(F.lit("200"), F.lit("oops"))
        ),
        query_params=F.when(odd, F.array(F.struct(F.lit("id").alias("name")))),
        auth_type=F.when(F.col("auth_type") == "bearer", "JWT").otherwise(F.upper("auth_type")),
        api_definition=F.struct(F.lit("shared").alias("namespace"), F.lit("def-x").alias("name")),
    )
    return v.endpoint_stats.select(*KEYS, body.alias("payload"))


def state_records(v: Views) -> DataFrame:
    odd = F.col("total_traffic_samples") % 2 == 1
    body = record(
        state=F.when(F.col("state") == "mature", "Matured").otherwise(F.upper("state")),
        confidence_score=F.when(odd, F.col("confidence_score")),
        confidence=F.when(~odd, F.col("confidence_score").cast("string")),
        total_endpoints_discovered=F.when(odd, F.col("total_endpoints_discovered")),
        endpoint_count=F.when(~odd, F.lit("several")),
        sample_count=F.col("total_traffic_samples").cast("string"),
        last_update=F.lit("2024-01-01"),
        state_changed_at=iso("state_changed_at"),
    )
    return v.states.select(*KEYS, body.alias("payload"))


# --- configuration objects ---------------------------------------------------------


def empty() -> Column:
    return F.create_map().cast("map<string,string>")


def named(name: Column, namespace: str = "shared") -> Column:
    return F.struct(name.alias("name"), F.lit(namespace).alias("namespace"))


def load_balancer_objects(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    site = F.struct(F.struct(named(word("ny", k % 25, "-nyc")).alias("site")).alias("site"))
    sites = F.array(
        F.to_json(site),
        F.to_json(F.struct(F.struct(named(word("vs", k % 4)).alias("virtual_site")).alias("virtual_site"))),
        F.lit('{"site":{}}'),
    )
    endpoint = F.struct(
        F.struct(word("ep-", k % 7).alias("name")).alias("metadata"),
        F.struct(word("/p", k % 7).alias("prefix"), F.lit("/x").alias("exact")).alias("path"),
        F.struct(
            F.when(k % 2 == 0, empty()).alias("block"),
            F.when(k % 2 == 1, empty()).alias("javascript_challenge"),
        ).alias("mitigation"),
    )
    unnamed = F.lit('{"path":{"prefix":"/none"}}')

    def text(cond: Column, json: Column | str) -> Column:
        return F.when(cond, json)

    members = {
        "domains": F.to_json(F.array(F.concat(F.lower("s_name"), F.lit(".example.com")))),
        "https_auto_cert": text(k % 4 == 0, '{"tls":{}}'),
        "https": text(
            k % 4 == 1,
            F.to_json(
                F.struct(
                    F.struct(F.array(named(word("cert-", k))).alias("certificates")).alias(
                        "tls_cert_params"
                    )
                )
            ),
        ),
        "http": text(k % 4 == 2, "{}"),
        "auto_cert_info": text(
            k % 8 == 0,
            F.to_json(
                F.struct(
                    word("CN=", k).alias("auto_cert_subject"),
                    F.lit("CA").alias("auto_cert_issuer"),
                    F.lit("2024-03-01T00:00:00Z").alias("auto_cert_expiry"),
                )
            ),
        ),
        "advertise_on_public_default_vip": text(k % 5 == 0, "{}"),
        "advertise_on_public": text(k % 5 == 1, "{}"),
        "advertise_custom": text(
            k % 5 == 2, F.concat(F.lit('{"advertise_where":['), F.concat_ws(",", sites), F.lit("]}"))
        ),
        "do_not_advertise": text(k % 5 == 3, "{}"),
        "app_firewall": F.when(k % 2 == 0, F.to_json(named(word("fw-", k % 5)))).otherwise("{}"),
        "bot_defense": F.when(k % 9 == 0, F.to_json(F.struct(named(word("bp-", k % 3)).alias("ref")))).when(
            k % 3 == 0,
            F.concat(
                F.lit('{"policy":{"protected_app_endpoints":['),
                F.to_json(endpoint),
                F.lit(","),
                unnamed,
                F.lit("]}}"),
            ),
        ),
        "bot_defense_advanced": text(k % 10 == 1, '{"mode":"on"}'),
        "active_service_policies": text(
            k % 5 == 0,
            F.to_json(
                F.struct(F.array(named(word("sp-", k % 11)), named(word("sp-", k % 11))).alias("policies"))
            ),
        ),
        "service_policies_from_namespace": text(k % 13 == 0, "{}"),
        "enable_api_discovery": text(k % 11 == 0, "{}"),
        "api_definition": text(
            k % 7 == 0,
            F.to_json(
                F.struct(
                    F.array(named(word("def-", k % 6))).alias("api_definitions"),
                    word("direct-", k % 6).alias("name"),
                )
            ),
        ),
        "default_route_pools": F.to_json(
            F.array(
                F.struct(named(word("pool-", k), "ns0").alias("pool")),
                F.struct(named(word("pool-", k * 7 % 50), "ns1").alias("pool")),
            )
        ),
    }
    spec = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",", *[F.when(c.isNotNull(), F.concat(F.lit(f'"{n}":'), c)) for n, c in members.items()]
        ),
        F.lit("}"),
    )
    under = F.when(k % 2 == 0, "get_spec").otherwise("spec")
    own_ns = F.when(k % 3 == 0, F.concat(F.lit('"namespace":"ns'), (k % 4).cast("string"), F.lit('",')))
    payload = F.concat(
        F.lit('{"name":"'),
        F.col("s_name"),
        F.lit('",'),
        F.coalesce(own_ns, F.lit("")),
        F.lit('"'),
        under,
        F.lit('":'),
        spec,
        F.lit("}"),
    )
    return v.table("supplier").select(
        word("t", k % 3).alias("tenant_id"), word("ns", k % 4).alias("namespace"), payload.alias("payload")
    )


def _object(tenant: Column, namespace: Column, name: Column, spec: Column) -> list[Column]:
    return [
        tenant.alias("tenant_id"),
        namespace.alias("namespace"),
        name.alias("name"),
        F.concat(
            F.lit('{"name":"'), name, F.lit('","namespace":"'), namespace, F.lit('","get_spec":'), spec, F.lit("}")
        ).alias("payload"),
    ]


def pool_objects(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    i = word("", k % 250)
    servers = nth(
        [
            '{"public_ip":{"ip":"10.2.0.#"}}',
            '{"private_ip":{"ip":"10.3.0.#"}}',
            '{"public_name":{"dns_name":"p#.example.com"}}',
            '{"private_ip":{},"private_name":{"dns_name":"q#.example.com"}}',
            '{"k8s_service":{"service_name":"svc#"}}',
            '{"consul_service":{"service_name":"con#"}}',
            '{"other":{}}',
        ],
        k % 7,
    )
    server = F.replace(servers, F.lit("#"), i)
    checks = F.when(k % 2 == 0, ',"healthcheck":[{"name":"hc-1"},{"name":""},{"name":"hc-2"}]').otherwise("")
    spec = F.concat(
        F.lit('{"port":'),
        F.when(k % 2 == 0, "443").otherwise("80"),
        F.lit(',"loadbalancer_algorithm":"LEAST_ACTIVE","origin_servers":['),
        server,
        F.lit(',{"public_ip":{"ip":"10.9.9.9"}}]'),
        checks,
        F.lit("}"),
    )
    return v.table("supplier").select(*_object(word("t", k % 3), word("ns", k % 4), word("pool-", k), spec))


def site_objects(v: Views) -> DataFrame:
    n = F.col("n_nationkey")
    kind = nth(["REGIONAL_EDGE", "ce", "INGRESS_EGRESS_GATEWAY", "VIRTUAL_SITE", "weird"], n % 5)
    name = F.when(n % 2 == 0, word("ny", n, "-nyc")).otherwise(word("branch_", n))
    spec = F.to_json(
        F.struct(
            F.when(n % 3 == 0, kind).alias("site_type"),
            word("region-", F.col("n_regionkey")).alias("region"),
            F.lit("aws").alias("provider"),
        )
    )
    payload = F.concat(
        F.lit('{"name":"'), name, F.lit('","spec":'), spec, F.lit(',"system_metadata":{"operational_status":"ONLINE"}}')
    )
    tenant = F.explode(F.array(*[F.lit(f"t{i}") for i in range(3)]))
    return v.table("nation").select(tenant.alias("tenant_id"), payload.alias("payload"))


def certificate_objects(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    auto = F.to_json(
        F.struct(
            word("auto", k).alias("auto_cert_subject_name"),
            iso(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("auto_cert_expiry"),
        )
    )
    spec = F.when(k % 3 == 0, F.concat(F.lit('{"auto_cert_info":'), auto, F.lit("}"))).otherwise(
        '{"certificate_url":"string:///x"}'
    )
    return v.table("orders").select(
        *_object(word("t", F.col("o_custkey") % 3), word("ns", k % 4), word("cert-", k), spec)
    )


def decoded_certificates(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    return v.table("orders").filter(k % 3 == 1).select(
        word("t", F.col("o_custkey") % 3).alias("tenant_id"),
        word("ns", k % 4).alias("namespace"),
        word("cert-", k).alias("name"),
        word("CN", F.col("o_custkey")).alias("subject"),
        F.lit("Test CA").alias("issuer"),
        F.array(word("h", k, ".example.com")).alias("san_dns"),
        F.col("o_orderdate").cast("timestamp").alias("not_before"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).cast("timestamp").alias("not_after"),
        F.hex(k).alias("serial_number"),
        F.lit(None).cast("string").alias("fingerprint_sha256"),
    )


def health_records(v: Views) -> DataFrame:
    """Origin health items, one per stored cell."""
    body = record(
        address=F.col("origin_address"),
        port=F.col("origin_port"),
        status=F.when(F.col("raw_status") != "OFFLINE", F.lower("raw_status")),
        consecutive_failures=F.when(F.col("consecutive_failures") > 9, F.col("consecutive_failures")),
        last_probe=iso("last_probe_at"),
        last_status_change=F.lit("never"),
    )
    return v.origin_health.select("tenant_id", "pool_id", "site_name", body.alias("payload"))


def policy_objects(v: Views, spec: Column) -> DataFrame:
    """Every customer as a policy object of the given settings."""
    c = F.col("c_custkey")
    ns = F.when(F.col("c_nationkey") == 0, "shared").otherwise(word("ns", c % 3))
    return v.table("customer").select(*_object(word("t", c % 3), ns, word("pol-", c), spec))


def _json(**members: Column) -> Column:
    """Object from JSON-text members, absent ones left out, order kept."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f'"{n}":'), c)) for n, c in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def firewall_objects(v: Views) -> DataFrame:
    c = F.col("c_custkey")
    spec = _json(
        blocking=F.when(c % 3 == 0, F.lit("{}")),
        monitoring=F.when(c % 3 == 1, F.lit("{}")),
        detection_settings=F.when(c % 5 == 0, F.lit('{"z":1}')),
        default_detection_settings=F.when(c % 5 == 1, F.lit("{}")),
        default_anonymization=F.when(c % 8 == 0, F.lit('{"zeta":{},"alpha":{}}')).otherwise('"plain"'),
        default_bot_setting=F.when(c % 7 == 0, F.lit('{"malicious":"BLOCK","good":"REPORT"}')),
        violation_settings=F.when(c % 5 < 3, F.lit('{"xss":{},"sqli":{},"blocking":{}}')),
        blocking_settings=F.when(
            c % 5 == 2, F.lit('{"rfi":{"action":"BLOCK"},"lfi":"BLOCKING","xxe":{"action":"REPORT"},"ssrf":"ALLOW"}')
        ),
        default_attack_categories_action=F.when(c % 11 == 0, F.lit("null")),
        custom_anonymization=F.when(c % 5 == 0, F.lit('{"rules":[1,2,3]}')),
        custom_violation_actions=F.when(c % 5 == 1, F.lit("[1,2]")),
        exclusion_rules=F.when(c % 13 == 0, F.lit("[{},{}]")),
        violation_settings_choice=F.when(c % 5 == 3, F.lit('{"exclusions":[1,2,3,4]}')),
        allowed_response_codes=F.when(c % 5 == 0, F.lit('{"response_code":[200,"x",302]}')).when(
            c % 5 == 1, F.lit("[404,1.5,500]")
        ),
    )
    return policy_objects(v, spec)


def service_policy_objects(v: Views) -> DataFrame:
    c = F.col("c_custkey")
    action = nth(
        ['{"deny_list":{}}', '{"legacy_default_action_next_policy":{},"allow_list":{}}', '{"custom_thing":{}}', "{}"],
        c % 5,
    )
    rules = [
        F.when(c % 8 == 1, F.lit('{"simple_rule":{"action":"Allow","country_list":[]}}')),
        F.when(c % 3 == 0, F.lit('{"custom_rule":{"action":"DENY","ip_matcher":{}}}')),
        F.when(c % 5 == 0, F.lit('{"action":"deny_list","path":{}}')),
        F.when(c % 7 == 0, F.lit('"not a rule"')),
        F.when(c % 11 == 0, F.lit('{"action":7}')),
    ]
    spec = _json(
        default_action_choice=action,
        rules=F.concat(F.lit("["), F.concat_ws(",", *rules), F.lit("]")),
    )
    return policy_objects(v, spec)


def two_spec_objects(v: Views) -> DataFrame:
    """Service policies whose read spec lacks the default action that the other spec has; every third is wrapped."""
    c = F.col("c_custkey")
    chosen = nth(['{"rules":[]}', '{"rules":[],"default_action_choice":{"next":{},"allow_list":{}}}', "{}"], c % 3)
    body = F.concat(
        F.lit('{"name":"pol-'), c.cast("string"), F.lit('","get_spec":'), chosen,
        F.lit(',"spec":{"default_action_choice":{"deny_list":{}}}}'),
    )
    quoted = F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"'))
    payload = F.when(c % 2 == 0, quoted).otherwise(body)
    return v.table("customer").select(
        word("t", c % 3).alias("tenant_id"), word("ns", c % 3).alias("namespace"), payload.alias("payload")
    )


def bot_policy_objects(v: Views) -> DataFrame:
    c = F.col("c_custkey")
    eps = [
        F.when(c % 2 == 0, F.lit('{"path":{"prefix":"/b","exact":"/a"},"mitigation":{"js_challenge":{}}}')),
        F.when(c % 3 == 0, F.lit('{"path":{"regex":"/a","n":5},"mitigation":{"captcha_challenge":{},"block":{}}}')),
        F.when(c % 5 == 0, F.lit('{"path":"/text","flow_label":{"redirect":{}}}')),
        F.when(c % 7 == 0, F.lit("9")),
    ]
    spec = _json(
        protected_app_endpoints=F.when(
            c % 10 != 6, F.concat(F.lit("["), F.concat_ws(",", *eps), F.lit("]"))
        )
    )
    return policy_objects(v, spec)


def api_definition_objects(v: Views) -> DataFrame:
    c = F.col("c_custkey")
    swagger = F.lit('{"swagger_spec":{"paths":{"/a":{"get":{},"POST":{},"x-note":{}},"/b":{"delete":{}}}}}')
    openapi = F.lit('{"openapi_spec":{"paths":{"/c":{"patch":{}},"/d":"text"}},"validation":{"on":true}}')
    specs = [
        F.when(c % 3 == 0, openapi),
        F.when(c % 8 == 3, swagger).otherwise('{"name":"bare"}'),
        F.when(c % 7 == 0, F.lit("5")),
    ]
    spec = _json(
        api_specs=F.when(c % 5 != 4, F.concat(F.lit("["), F.concat_ws(",", *specs), F.lit("]"))),
        validation_rules=F.when(c % 11 == 0, F.lit('{"r":1}')),
    )
    return policy_objects(v, spec)
