from datetime import datetime, timedelta

from pyspark.sql import functions as F

from edgeline.operators import merge, retention, tables
from edgeline.session import scratch_path
from helpers import dt, rows

T0 = datetime(2024, 5, 1, 12)


def test_append_twice_is_once(spark, folder):
    day = timedelta(days=1)
    schema = "event_time timestamp, id string, tenant_id string, lb_namespace string, lb_name string, action string, seq int"

    def batch(*data):
        return spark.createDataFrame([(t, i, "t", "n", lb, a, s) for t, i, lb, a, s in data], schema)

    path = folder + "/events"
    first = batch((T0, "a", "lb", "kept", 1), (T0, "a", "lb", "copy", 2), (T0 + day, "b", "lb", "b", 1))
    tables.append_events(first, path, "seq")
    tables.append_events(first, path, "seq")
    # the same identifier at another load balancer is another event
    tables.append_events(batch((T0, "a", "lb", "again", 0), (T0, "a", "other", "x", 0), (T0 - day, "c", "lb", "c", 1)), path, "seq")
    stored = spark.read.parquet(path)
    assert rows(stored.select("id", "lb_name", "action")) == [
        ("a", "lb", "kept"),
        ("a", "other", "x"),
        ("b", "lb", "b"),
        ("c", "lb", "c"),
    ]
    assert "event_date" in stored.columns


def test_ties_in_landing_order_repeat(spark):
    rows_ = [("k", 1, f"v{i}") for i in range(50)]
    frames = [spark.createDataFrame(r, "k string, at int, v string").repartition(n) for n, r in ((3, rows_), (5, rows_[::-1]))]
    got = {merge.one_per_key(f, ["k"], F.col("at"), newest=True).first()["v"] for f in frames}
    assert len(got) == 1


def test_bucket_upsert_rewrites_touched_days_only(spark, folder):
    schema = "bucket_time timestamp, tenant_id string, lb_namespace string, lb_name string, request_count bigint, seq int"

    def batch(*data):
        return spark.createDataFrame([(t, "t", "n", lb, c, s) for t, lb, c, s in data], schema)

    path = folder + "/minutes"
    day = timedelta(days=1)
    tables.upsert_buckets(
        batch((T0, "a", 1, 0), (T0, "b", 2, 0), (T0 + day, "a", 3, 0)), path, merge.METRIC_KEYS, "seq"
    )
    tables.upsert_buckets(batch((T0, "a", 9, 1), (T0, "a", 8, 0)), path, merge.METRIC_KEYS, "seq")
    got = spark.read.parquet(path).select("bucket_time", "lb_name", "request_count")
    assert rows(got) == [(T0, "a", 9), (T0, "b", 2), (T0 + day, "a", 3)]


def test_snapshot_versions(spark, folder):
    table = tables.SnapshotTable(spark, folder + "/s", "k string, n bigint")
    assert table.read().count() == 0
    for i in range(6):
        table.write(spark.createDataFrame([("x", i)], "k string, n bigint"), version=i)
    assert rows(table.read()) == [("x", 5)]
    assert rows(table.read(before=5)) == [("x", 4)]
    assert table.versions()[-1] == 5 and len(table.versions()) <= 4


def test_reaping_scopes(spark):
    target = spark.createDataFrame(
        [("t", "a", "old", T0), ("t", "a", "new", T0 + timedelta(hours=1)), ("t", "b", "old", T0)],
        "tenant_id string, namespace string, name string, last_seen_at timestamp",
    )
    listings = spark.createDataFrame(
        [("t", "a", True), ("t", "a", False), ("t", "b", False)],
        "tenant_id string, namespace string, ok boolean",
    )
    scope = ["tenant_id", "namespace"]
    sync = T0 + timedelta(minutes=30)
    kept = merge.reap_stale(target, sync, merge.scopes_with_success(listings, scope), scope)
    assert rows(kept.select("namespace", "name")) == [("a", "new"), ("b", "old")]
    none = merge.scopes_with_success(listings.filter("NOT ok"), scope)
    assert merge.reap_stale(target, sync, none, scope).count() == 3


ALERT_SCHEMA = (
    "tenant_id string, rule_id string, dedupe_key string, severity string, status string, "
    "title string, description string, context string, occurrence_count bigint, "
    "first_seen_at timestamp, last_seen_at timestamp, acknowledged_at timestamp, "
    "resolved_at timestamp, last_batch_id bigint"
)


def candidates(spark, *keys):
    return spark.createDataFrame(
        [("t", "r", k, "info", f"title {i}", "d", "{}", i) for i, k in enumerate(keys)],
        "tenant_id string, rule_id string, dedupe_key string, severity string, title string, "
        "description string, context string, ord bigint",
    )


def test_alert_merge_counts_and_replays(spark):
    empty = spark.createDataFrame([], ALERT_SCHEMA)
    one = merge.alert_merge(empty, candidates(spark, "a", "a", "b"), T0, batch_id=1)
    picked = ["dedupe_key", "occurrence_count", "title", "status", "last_batch_id"]
    assert rows(one.select(*picked)) == [
        ("a", 2, "title 1", "open", 1),
        ("b", 1, "title 2", "open", 1),
    ]
    replay = merge.alert_merge(one, candidates(spark, "a", "a", "b"), T0, batch_id=1)
    assert rows(replay) == rows(one)
    resolved = one.withColumn("status", F.lit("resolved")).withColumn("resolved_at", F.lit(T0))
    later = T0 + timedelta(hours=1)
    two = merge.alert_merge(resolved, candidates(spark, "a"), later, batch_id=2)
    got = {r["dedupe_key"]: r for r in two.collect()}
    assert got["a"]["occurrence_count"] == 3 and got["a"]["status"] == "resolved"
    assert got["a"]["first_seen_at"] == T0 and got["a"]["last_seen_at"] == later
    assert got["b"]["occurrence_count"] == 1 and got["b"]["last_seen_at"] == T0


def replayed(status, ack, res, steps):
    """Brute force: apply the actions one after the other."""
    for action, at in steps:
        if action == "reopen":
            status, ack, res = "open", None, None
        elif action == "acknowledge":
            status, ack = "acknowledged", ack or at
        else:
            status, res, ack = "resolved", at, ack or at
    return status, ack, res


def test_alert_transitions_match_replay(spark):
    import itertools

    kinds = ["acknowledge", "resolve", "reopen"]
    plans = [p for n in (1, 2, 3) for p in itertools.product(kinds, repeat=n)]
    starts = [("open", None, None), ("resolved", T0, T0)]
    alerts, actions, want = [], [], {}
    for i, (plan, start) in enumerate(itertools.product(plans, starts)):
        steps = [(a, T0 + timedelta(hours=j + 1)) for j, a in enumerate(plan)]
        alerts.append(("t", "r", str(i), *start))
        actions += [("t", "r", str(i), a, at) for a, at in steps]
        want[str(i)] = replayed(*start, steps)
    a = spark.createDataFrame(
        alerts,
        "tenant_id string, rule_id string, dedupe_key string, status string, "
        "acknowledged_at timestamp, resolved_at timestamp",
    )
    b = spark.createDataFrame(
        actions,
        "tenant_id string, rule_id string, dedupe_key string, action string, at timestamp",
    )
    out = merge.alert_transition(a, b).collect()
    got = {r["dedupe_key"]: (r["status"], r["acknowledged_at"], r["resolved_at"]) for r in out}
    assert got == want


def test_profile_merge_with_null_identity(spark):
    schema = (
        "tenant_id string, source_ip string, source_asn bigint, source_country string, "
        "total_events bigint, first_seen_at timestamp, last_seen_at timestamp"
    )
    hour = timedelta(hours=1)
    old = spark.createDataFrame(
        [("t", "a", None, None, 5, T0, T0 + hour), ("t", "gone", 1, "US", 7, T0, T0)], schema
    )
    new = spark.createDataFrame([("t", "a", None, None, 2, T0 + hour, T0 + 2 * hour)], schema)
    once = merge.attacker_profile_merge(old, new)
    assert rows(once) == rows(merge.attacker_profile_merge(once, new))
    got = {r["source_ip"]: r for r in once.collect()}
    assert len(got) == 2 and got["gone"]["total_events"] == 7
    assert got["a"]["total_events"] == 2
    assert (got["a"]["first_seen_at"], got["a"]["last_seen_at"]) == (T0, T0 + 2 * hour)


def test_old_partitions_are_dropped(spark, folder):
    path = folder + "/aged"
    data = [(T0 + timedelta(days=d), "x") for d in range(5)]
    df = spark.createDataFrame(data, "event_time timestamp, id string")
    df.withColumn("event_date", F.to_date("event_time")).write.partitionBy("event_date").parquet(path)
    gone = retention.drop_old_partitions(spark, path, "event_date", dt("2024-05-03").date())
    assert gone == ["2024-05-01", "2024-05-02"]
    left = spark.read.parquet(path)
    kept = retention.retention(left, "event_time", 1, T0 + timedelta(days=4))
    assert left.count() == 3 and kept.count() == 2


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
