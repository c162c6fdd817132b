import json

from edgeline.operators.joins import declared_endpoints
from edgeline.sources import apis, config, events, landing, metrics, policies
from helpers import dt, objects, raw, rows


def first(df):
    return df.first().asDict()


def test_waf_event_live_and_stored_spelling(spark):
    live = {
        "@timestamp": "2024-05-01T10:00:00.123Z",
        "req_id": "6f9619ff-8b86-d011-b42d-00cf4fc964ff",
        "src_ip": "10.0.0.1",
        "country": "US",
        "asn": "Example (64500)",
        "req_path": "/a",
        "url": "/ignored",
        "action": "blocked",
        "rsp_code": "403",
        "sec_event_name": "Illegal Filetype",
        "sec_event_type": "waf_sec_event",
        "violation_ids": ["V1"],
    }
    got = first(events.waf_events_from_raw(raw(spark, json.dumps(live))))
    assert got["event_time"] == dt("2024-05-01T10:00:00.123000")
    assert got["id"] == live["req_id"]
    assert (got["action"], got["source_asn"], got["url"]) == ("BLOCK", 64500, "/a")
    assert (got["response_code"], got["primary_signature"]) == (403, "Illegal Filetype")
    assert got["signature_ids"] == '["V1"]'
    assert got["waf_policy_name"] is None and got["waf_policy_namespace"] is None

    stored = {
        "event_time": "2024-05-01T10:00:00Z",
        "src_asn": 7,
        "src_country": "DE",
        "url": "/b",
        "violation_name": "V",
        "waf_policy": {"namespace": "shared", "name": "fw"},
    }
    got = first(events.waf_events_from_raw(raw(spark, stored)))
    assert (got["source_asn"], got["source_country"], got["action"]) == (7, "DE", "ALLOW")
    assert (got["waf_policy_namespace"], got["waf_policy_name"]) == ("shared", "fw")


def test_waf_event_policy_as_text(spark):
    item = {"time": "2024-05-01", "waf_policy": "fw", "sec_event_name": "S"}
    got = first(events.waf_events_from_raw(raw(spark, item)))
    assert (got["waf_policy_namespace"], got["waf_policy_name"]) == ("ns", "S")
    # text that merely looks like an object stays text
    item["waf_policy"] = '{"name":"x"}'
    got = first(events.waf_events_from_raw(raw(spark, item)))
    assert got["waf_policy_name"] == "S"


def test_unreadable_records_are_dropped(spark):
    good = {"timestamp": "2024-05-01T10:00:00Z"}
    wrapped = json.dumps(json.dumps(good))
    df = raw(spark, "{broken", "[1]", "7", {"timestamp": "later"}, {}, good, wrapped)
    assert events.waf_events_from_raw(df).count() == 2


def test_empty_values_fall_through(spark):
    item = {
        "@timestamp": "",
        "event_time": None,
        "timestamp": 0,
        "time": "2024-05-01T00:00:00Z",
        "src_ip": "",
        "source_ip": "10.0.0.9",
        "country": False,
        "src_country": [],
        "source_country": "FR",
        "req_path": "x" * 3000,
        "user_agent": "y" * 600,
    }
    got = first(events.waf_events_from_raw(raw(spark, item)))
    assert (got["source_ip"], got["source_country"]) == ("10.0.0.9", "FR")
    assert len(got["url"]) == 3000 and len(got["user_agent"]) == 600


def test_bot_filter(spark):
    t = "2024-05-01T00:00:00Z"
    yes = [
        {"time": t, "sec_event_type": "bot_defense_sec_event"},
        {"time": t, "bot_defense": {"action": "x"}},
        {"time": t, "bot_score": "0"},
    ]
    no = [
        {"time": t},
        {"time": t, "bot_defense": {}},
        {"time": t, "bot_score": 0},
        {"time": t, "bot_category": ""},
    ]
    assert events.bot_filter(raw(spark, *yes, *no)).count() == len(yes)


def test_standard_bot_event(spark):
    base = {"@timestamp": "2024-05-01T00:00:00Z", "sec_event_name": "Bot Defense Violation"}
    challenged = {
        **base,
        "bot_defense": {
            "action": "js_challenge",
            "insight": "MALICIOUS",
            "bot_score": "85",
            "challenge": {"type": "js", "result": "Passed"},
            "policy": {"name": "p"},
        },
    }
    got = first(events.bot_events_standard(raw(spark, challenged)))
    assert (got["action"], got["bot_category"]) == ("CHALLENGE", "bad_bot")
    assert (got["confidence_score"], got["confidence_bucket"]) == (85, "high")
    assert (got["challenge_result"], got["challenge_type"]) == ("passed", "js")
    assert (got["bot_policy_namespace"], got["bot_policy_name"]) == ("ns", "p")

    # a result is reported for challenges only; a missing one was abandoned
    blocked = {**base, "bot_defense": {"action": "BLOCKED", "challenge": {"result": "failed"}}}
    got = first(events.bot_events_standard(raw(spark, blocked)))
    assert (got["challenge_result"], got["challenge_type"]) == ("not_issued", None)
    open_ = {**base, "bot_defense": {"action": "CHALLENGE"}}
    assert first(events.bot_events_standard(raw(spark, open_)))["challenge_result"] == "abandoned"
    odd = {**base, "bot_defense": {"action": "CHALLENGE", "challenge": "text"}}
    assert first(events.bot_events_standard(raw(spark, odd)))["challenge_result"] == "not_issued"


def test_score_zero(spark):
    t = "2024-05-01T00:00:00Z"
    cases = {
        # the nested 0 is empty, nothing follows
        None: {"time": t, "bot_defense": {"x": 1, "bot_score": 0}},
        # an empty last value is kept
        0: {"time": t, "bot_defense": {"x": 1}, "bot_score": 0},
        # the nested 0 falls through to the outer score
        60: {"time": t, "bot_defense": {"x": 1, "bot_score": 0}, "bot_score": 60},
    }
    for want, item in cases.items():
        got = first(events.bot_events_standard(raw(spark, item)))
        assert got["confidence_score"] == want
    text = {"time": t, "bot_defense": {"x": 1, "bot_score": "0"}, "bot_score": 60}
    assert first(events.bot_events_standard(raw(spark, text)))["confidence_score"] == 0
    half = {"time": t, "bot_defense": {"x": 1, "bot_score": 60.5}}
    assert first(events.bot_events_standard(raw(spark, half)))["confidence_score"] is None


def test_advanced_bot_event(spark):
    item = {
        "event_time": "2024-05-01T00:00:00Z",
        "action": "BLOCK",
        "bot_category": "Headless Browser",
        "confidence_score": 91,
        "challenge": {"type": "captcha", "result": "FAILED"},
        "device_anomalies": ["a", "b"],
        "bot_policy": {"namespace": "shared", "name": "p"},
    }
    got = first(events.bot_events_advanced(raw(spark, item)))
    assert (got["challenge_result"], got["challenge_type"]) == ("failed", "captcha")
    assert got["device_anomalies"] == ["a", "b"] and got["bot_policy_name"] == "p"
    item.update(challenge={"result": "odd"}, device_anomalies="text")
    got = first(events.bot_events_advanced(raw(spark, item)))
    assert got["challenge_result"] == "not_issued" and got["device_anomalies"] is None
    item.update(action="CHALLENGE", challenge={})
    assert first(events.bot_events_advanced(raw(spark, item)))["challenge_result"] == "abandoned"


def test_waf_metric_shapes(spark):
    series = {
        "data": [
            {
                "metric": "loadbalancer.request_count",
                "values": [
                    ["2024-05-01T00:00:00Z", 10],
                    ["2024-05-01T00:01:00Z", "20"],
                    ["2024-05-01T00:01:00Z", 21.9],
                    ["bad", 1],
                    ["2024-05-01T00:02:00Z", "x"],
                    ["2024-05-01T00:02:00Z", "1.5"],
                    ["2024-05-01T00:02:00Z"],
                    ["2024-05-01T00:02:00Z", 1, 2],
                    [1714521600, 5],
                    "cell",
                ],
            },
            {"metric": "loadbalancer.waf_blocked_count", "values": [["2024-05-01T00:00:00Z", 3]]},
            {"metric": "loadbalancer.unknown", "values": [["2024-05-01T00:05:00Z", 3]]},
            5,
        ]
    }
    flat = {
        "step": "5m",
        "data": [
            {"bucket_time": "2024-05-01T00:00:00Z", "request_count": 4, "waf_blocked_count": "2"},
            {"timestamp": "2024-05-01T00:05:00Z", "error_count": 1},
            {"bucket_time": "2024-05-01T00:06:00Z", "error_count": "no"},
            {"bucket_time": "never", "request_count": 4},
        ],
    }
    cols = ["bucket_time", "request_count", "blocked_count", "monitored_count", "error_count"]
    got = rows(metrics.waf_metric_buckets(raw(spark, series)).select(*cols))
    assert got == [
        (dt("2024-05-01T00:00:00"), 10, 3, 0, 0),
        (dt("2024-05-01T00:01:00"), 21, 0, 0, 0),
    ]
    got = rows(metrics.waf_metric_buckets(raw(spark, flat)).select(*cols))
    assert got == [
        (dt("2024-05-01T00:00:00"), 4, 2, 0, 0),
        (dt("2024-05-01T00:05:00"), 0, 0, 0, 1),
    ]


def test_api_metric_buckets(spark):
    t = "2024-05-01T00:00:00Z"
    labels = {"method": " get", "path": "/a "}
    payload = {
        "data": [
            {"metric": "loadbalancer.request_count", "labels": labels, "values": [[t, 5]]},
            {"metric": "loadbalancer.http_4xx_count", "labels": labels, "values": [[t, "bad"]]},
            {"metric": "loadbalancer.latency_p50", "labels": labels, "values": [[t, 1.5], [t, "x"]]},
            {"metric": "loadbalancer.latency_p99", "labels": labels, "values": [[t, "9.25"]]},
            {"metric": "loadbalancer.request_count", "labels": {"method": "GET"}, "values": [[t, 5]]},
            {"metric": "loadbalancer.request_count", "values": [[t, 5]]},
        ]
    }
    got = rows(
        metrics.api_metric_buckets(raw(spark, payload)).select(
            "method",
            "endpoint_path",
            "request_count",
            "error_4xx_count",
            "latency_p50_ms",
            "latency_p99_ms",
        )
    )
    assert got == [("GET", "/a", 5, 0, None, 9.25)]


def test_api_endpoint_fields(spark):
    item = {
        "http_method": "post ",
        "url": " /x",
        "confidence": "70",
        "sample_count": 12.9,
        "observed_response_codes": [200, "201", None],
        "authentication": "api-key",
        "first_seen_at": "2024-05-01T00:00:00Z",
        "body_params": [{"name": "a"}],
        "query_params": {"no": "list"},
    }
    got = first(apis.api_endpoints_from_raw(raw(spark, item)))
    assert (got["method"], got["endpoint_path"]) == ("POST", "/x")
    assert (got["discovery_confidence"], got["total_request_samples"]) == (70, 12)
    assert got["response_codes"] == [200, 201] and got["auth_type"] == "apikey"
    assert got["body_params"] == '[{"name":"a"}]' and got["query_params"] is None
    item["observed_response_codes"] = [200, "oops"]
    assert first(apis.api_endpoints_from_raw(raw(spark, item)))["response_codes"] is None
    assert apis.api_endpoints_from_raw(raw(spark, {"method": "GET"}, {"path": "/a"})).count() == 0


def test_shadow_needs_an_exact_declaration(spark):
    definition = {
        "name": "d",
        "namespace": "shared",
        "get_spec": {
            "api_specs": [{"openapi_spec": {"paths": {"/a": {"get": {}}, "/u/{id}": {"get": {}}}}}]
        },
    }
    definitions = policies.api_definition_config(objects(spark, definition))
    links = spark.createDataFrame(
        [("t", "ns", "lb", "api_definition", "shared", "d")],
        "tenant_id string, lb_namespace string, lb_name string, policy_type string, "
        "policy_namespace string, policy_name string",
    )
    assert declared_endpoints(links, definitions).count() == 2
    items = [{"method": "get", "path": p, "api_definition": {"name": "d"}} for p in ("/a", "/u/7")]
    got = apis.api_endpoint_inventory(raw(spark, *items), links, definitions)
    picked = got.select("endpoint_path", "is_shadow", "api_definition_name")
    assert rows(picked) == [("/a", False, "d"), ("/u/7", True, None)]
    other = raw(spark, *items, lb="other")
    assert apis.api_endpoint_inventory(other, links, definitions).filter("is_shadow").count() == 2


def test_load_balancer_shapes(spark):
    def lb(spec, **extra):
        item = {"name": "lb", "namespace": "own", "spec": spec, **extra}
        return first(config.lb_config(objects(spark, item)))

    got = lb({"https_auto_cert": {}, "http": {}, "advertise_on_public": {}})
    assert (got["lb_type"], got["advertise_mode"]) == ("https", "advertise_on_public")
    assert got["advertised_sites"] == ["__all_re__"] and got["namespace"] == "own"
    got = lb({"http": {}, "do_not_advertise": None, "app_firewall": {}})
    assert (got["lb_type"], got["advertised_sites"], got["has_waf"]) == ("http", [], False)
    got = lb(
        {
            "advertise_custom": {
                "advertise_where": [
                    {"site": {"site": {"name": "s1"}}},
                    {"virtual_site": {"virtual_site": {"name": "v1"}}},
                    {"site": None},
                    {"other": {}},
                ]
            },
            "service_policies_from_namespace": {},
            "default_route_pools": [{"pool": {"name": "p1"}}, {"pool": {}}, {}],
            "https": {"tls_cert_params": {"certificates": [{"name": "c1"}, {"name": "c2"}]}},
        }
    )
    assert got["advertised_sites"] == ["s1", "virtual:v1"] and got["has_service_policy"]
    assert got["origin_pool_refs"] == ["p1"] and got["cert_ref"] == "c1"
    got = lb({}, get_spec={"domains": ["a", "b"]}, namespace="")
    assert got["domains"] == ["a", "b"] and got["lb_type"] == "unknown"
    assert got["namespace"] == "ns" and got["advertise_mode"] is None


def test_landed_json_lines(spark, folder):
    path = folder + "/landed.json"
    with open(path, "w") as f:
        f.write(json.dumps({"tenant_id": "t", "lb_name": "a", "payload": {"time": "2024-05-01"}}) + "\n")
        f.write(
            json.dumps({"tenant_id": "t", "lb_name": "b", "payload": '{"time": "2024-05-02"}'}) + "\n"
        )
    got = events.waf_events_from_raw(landing.read_records(spark, path))
    assert rows(got.select("lb_name", "event_time")) == [
        ("a", dt("2024-05-01T00:00:00")),
        ("b", dt("2024-05-02T00:00:00")),
    ]
