"""Operators against brute force on small fixtures, and invariants between them."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from edgeline.functions.ranking import top_per_group
from edgeline.operators import alerts, bot, joins, security, waf
from edgeline.operators.transitions import state_transitions
from edgeline.plans.views import Views
from helpers import rows

NOW = datetime(2024, 5, 1, 12)


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, "/root/testdata/sf0.001")


def random_events(n, seed):
    r = random.Random(seed)
    waf_rows, bot_rows = [], []
    for i in range(n):
        # one address sends a third of everything
        ip = "10.0.0.1" if r.random() < 0.34 else r.choice([None, "", *[f"10.0.1.{k}" for k in range(8)]])
        asn, country = r.choice([None, 7, 8]), r.choice([None, "US", "DE"])
        at = NOW - timedelta(minutes=r.randrange(0, 2000))
        lb = f"lb{r.randrange(4)}"
        path = r.choice([None, "", "/a", "/b", "/c"])
        common = ("t", ip, asn, country, at, str(i), "ns", lb)
        if r.random() < 0.6:
            waf_rows.append(
                (*common, r.choice(["BLOCK", "MONITOR", "ALLOW", "REDIRECT"]), path,
                 r.choice([None, "S1", "S2"]), r.choice([None, 200, 403, 500]))
            )
        else:
            bot_rows.append((*common, r.choice(["BLOCK", "CHALLENGE", "MONITOR", "ALLOW"]), path))
    return waf_rows, bot_rows


BASE = (
    "tenant_id string, source_ip string, source_asn bigint, source_country string, "
    "event_time timestamp, id string, lb_namespace string, lb_name string, action string, "
)


def correlate(waf_rows, bot_rows, start):
    """The same counts in plain Python."""
    out = defaultdict(lambda: {"c": Counter(), "ep": Counter(), "sig": Counter(), "lb": set(), "t": []})

    def note(p, row, path, sig):
        if path:
            p["ep"][path] += 1
        if sig:
            p["sig"][sig] += 1
        p["lb"].add(row[7])
        p["t"].append(row[4])

    for row in waf_rows:
        if not row[1] or not start <= row[4] <= NOW:
            continue
        p = out[row[1:4]]
        action, path, sig, code = row[8:]
        p["c"]["waf_block"] += action == "BLOCK"
        p["c"]["waf_monitor"] += action == "MONITOR"
        p["c"]["api_4xx"] += code is not None and 400 <= code <= 499
        if action != "ALLOW":
            note(p, row, path, sig)
    for row in bot_rows:
        if not row[1] or not start <= row[4] <= NOW:
            continue
        p = out[row[1:4]]
        action, path = row[8:]
        p["c"]["bot_block"] += action == "BLOCK"
        p["c"]["bot_challenge"] += action == "CHALLENGE"
        if action != "ALLOW":
            note(p, row, path, None)

    def top(c):
        return min(c, key=lambda v: (-c[v], v)) if c else None

    return {
        k: (
            *[p["c"][n] for n in ("waf_block", "waf_monitor", "bot_block", "bot_challenge", "api_4xx")],
            sum(p["c"].values()),
            top(p["ep"]),
            top(p["sig"]),
            len(p["lb"]),
            min(p["t"], default=None),
            max(p["t"], default=None),
        )
        for k, p in out.items()
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_correlation_matches_brute_force(spark, seed):
    waf_rows, bot_rows = random_events(1500, seed)
    w = spark.createDataFrame(
        waf_rows, BASE + "url string, primary_signature string, response_code int"
    )
    b = spark.createDataFrame(bot_rows, BASE + "endpoint_path string")
    got = security.attacker_correlation(w, b, as_of=NOW)
    want = correlate(waf_rows, bot_rows, NOW - timedelta(minutes=1440))
    cols = [
        "waf_block_count",
        "waf_monitor_count",
        "bot_block_count",
        "bot_challenge_count",
        "api_4xx_count",
        "total_events",
        "top_endpoint",
        "top_signature",
        "distinct_lbs",
        "first_seen_at",
        "last_seen_at",
    ]
    found = {
        (r["source_ip"], r["source_asn"], r["source_country"]): tuple(r[c] for c in cols)
        for r in got.collect()
    }
    assert found == want


def test_large_top_n_of_a_hot_group(spark):
    r = random.Random(3)
    data = [("hot" if i % 3 else "cold", r.randrange(500), i) for i in range(12000)]
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(13)
    for n, offset in ((5, 0), (5, 3), (1500, 0), (1200, 700)):
        got = top_per_group(df, ["g"], [F.desc("v"), F.asc("id")], n, offset=offset)
        want = []
        for g in ("hot", "cold"):
            ordered = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))
            want += ordered[offset : offset + n]
        assert rows(got) == sorted(want, key=str)


def test_transitions_match_brute_force(spark):
    r = random.Random(5)
    data = []
    for i in range(2000):
        lb = "hot" if i % 3 else f"lb{i % 5}"
        data.append(("t", "n", lb, r.choice("abc"), NOW + timedelta(minutes=7 * i), i))
    df = spark.createDataFrame(
        data,
        "tenant_id string, lb_namespace string, lb_name string, state string, seen_at timestamp, snapshot_id bigint",
    )
    want, last = [], {}
    for _, _, lb, state, at, i in data:
        if lb in last and last[lb] != state:
            want.append((lb, i, last[lb], state, at))
        last[lb] = state
    for slot in ("hour", "day"):
        got = state_transitions(df, slot=slot)
        picked = got.select("lb_name", "snapshot_id", "from_state", "to_state", "changed_at")
        assert rows(picked) == sorted(want, key=str)


def test_sparkline_adds_up_to_overview(views):
    v = views
    week = timedelta(hours=24)
    over = waf.waf_overview(v.waf_events, as_of=v.as_of, minutes=1440).collect()
    line = waf.waf_sparkline(v.waf_events, as_of=v.as_of, hours=24)
    sums = line.groupBy("tenant_id").agg(
        F.sum("request_count").alias("n"), F.sum("blocked_count").alias("b")
    )
    got = {r["tenant_id"]: (r["n"], r["b"]) for r in sums.collect()}
    assert got == {r["tenant_id"]: (r["total_requests"], r["total_blocked"]) for r in over} and week


def test_unlimited_topk_adds_up(views):
    v = views
    top = bot.bot_topk(v.bot_events, "source_country", as_of=v.as_of, hours=168, k=1000)
    total = (
        v.bot_events.filter("source_country IS NOT NULL")
        .filter(F.col("event_time") >= F.date_trunc("second", v.as_of) - F.expr("INTERVAL 168 HOURS"))
        .filter(F.col("event_time") <= F.date_trunc("second", v.as_of))
        .count()
    )
    assert top.agg(F.sum("count")).first()[0] == total


def test_total_is_the_sum_of_its_signals(views):
    got = security.attacker_correlation(
        views.waf_events, views.bot_events, as_of=views.as_of, window=timedelta(days=30)
    )
    parts = "waf_block_count + waf_monitor_count + bot_block_count + bot_challenge_count + api_4xx_count"
    assert got.filter(f"total_events <> {parts}").count() == 0 and got.count() > 0


def test_a_failing_rule_does_not_stop_the_others(views):
    v = views
    inputs = alerts.Tables(
        waf_metrics=v.waf_metrics.withColumn("blocked_count", F.expr("raise_error('broken')")),
        waf_events=v.waf_events,
        bot_events=v.bot_events,
        states=v.states,
        endpoints=v.api_endpoints,
        certificates=v.certificates,
    )
    found, failed = alerts.evaluate_rules(inputs, v.as_of)
    assert failed == ["waf.block_burst"]
    assert {r[0] for r in found.select("rule_id").distinct().collect()} >= {"cert.expiry"}
    off = alerts.RuleSettings(enabled=set())
    assert alerts.evaluate_rules(inputs, v.as_of, off) == (None, [])


def test_block_burst_bounds_are_inclusive(spark):
    df = spark.createDataFrame(
        [("t", "n", "at", NOW, 50), ("t", "n", "edge", NOW - timedelta(minutes=5), 51),
         ("t", "n", "old", NOW - timedelta(minutes=6), 99), ("t", "n", "few", NOW, 49)],
        "tenant_id string, lb_namespace string, lb_name string, bucket_time timestamp, blocked_count bigint",
    )
    got = alerts.waf_block_burst(df, as_of=NOW)
    assert rows(got.select("dedupe_key")) == [("lb:n/at",), ("lb:n/edge",)]


def test_matrix_counts_missing_cells(spark):
    cells = [("t", "p", "a", 1, "s1", "healthy", 0), ("t", "p", "b", None, "s2", "unhealthy", 3)]
    big = [("t", "big", f"o{i}", 1, f"s{j}", "healthy", 0) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(
        cells + big,
        "tenant_id string, pool_id string, origin_address string, origin_port int, site_name string, "
        "classified_status string, consecutive_failures int",
    )
    got = joins.health_matrix(df)
    small = got.filter("pool_id = 'p'").select("origin_address", "origin_port", "site_name", "status", "sites_without_probe")
    assert rows(small) == [("a", 1, "s1", "healthy", 1), ("b", None, "s2", "unhealthy", 1)]
    assert got.filter("pool_id = 'big' AND sites_without_probe = 0").count() == 25
