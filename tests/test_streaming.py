import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from edgeline.operators import merge, rollups, tables
from edgeline.operators.transitions import changes, state_transitions
from edgeline.streaming import jobs, transforms
from helpers import rows

T0 = datetime(2024, 5, 1, 12)
EVENT = (
    "event_time timestamp, id string, tenant_id string, lb_namespace string, lb_name string, action string, "
    "landed_at timestamp"
)


def event(minute, key, action="BLOCK", lb="lb", landed=0):
    return (T0 + timedelta(minutes=minute), key, "t", "n", lb, action, T0 + timedelta(days=9, minutes=landed))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def land(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def shuffled_batches(seed, n=6):
    """Events over four days in random order, every fourth landing twice, cut into batches."""
    r = random.Random(seed)
    events = [event(r.randint(0, 4 * 1440), f"e{i}", r.choice(["BLOCK", "ALLOW", "MONITOR"]), f"lb{i % 3}") for i in range(240)]
    rows_ = events + [(*e[:5], "ALLOW", e[6] + timedelta(hours=1)) for e in events[::4]]
    r.shuffle(rows_)
    return [rows_[i::n] for i in range(n)], events


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_minutes_and_hours_equal_one_batch(spark, folder, zone, monkeypatch):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        batches, events = shuffled_batches(1)
        handle = jobs.event_metrics(folder + "/e", folder + "/m", folder + "/h")
        handle(spark.createDataFrame([], EVENT), 0)
        for i, data in enumerate(batches):
            handle(spark.createDataFrame(data, EVENT), i)
        handle(spark.createDataFrame(batches[2], EVENT), 2)
        whole = spark.createDataFrame(events, EVENT)
        keys = ["bucket_time", "lb_name", "request_count"]
        minutes = rollups.minute_metrics(whole)
        stored = spark.read.parquet(folder + "/m")
        assert rows(stored.groupBy("bucket_time", "lb_name").agg(F.sum("request_count").alias("n"))) == rows(
            minutes.groupBy("bucket_time", "lb_name").agg(F.sum("request_count").alias("n"))
        )
        assert rows(spark.read.parquet(folder + "/h").select(*keys)) == rows(rollups.waf_rollup_1hour(minutes).select(*keys))
        assert spark.read.parquet(folder + "/e").count() == len(events)
    finally:
        monkeypatch.undo()
        time.tzset()


def test_the_copy_landed_first_stays(spark, folder):
    handle = jobs.ingest_events(folder + "/e")
    late, first = event(0, "a", "ALLOW", landed=5), event(0, "a", "BLOCK", landed=1)
    handle(spark.createDataFrame([late, first], EVENT), 0)
    handle(spark.createDataFrame([event(0, "a", "MONITOR"), event(0, "a", "BLOCK", "other")], EVENT), 1)
    got = spark.read.parquet(folder + "/e").select("lb_name", "action")
    assert rows(got) == [("lb", "BLOCK"), ("other", "BLOCK")]


def test_stuffing_windows_equal_one_batch(spark, folder):
    r = random.Random(3)
    schema = EVENT + ", source_ip string, source_country string, source_asn bigint, challenge_result string, endpoint_path string"
    data = [
        event(r.randint(0, 900), f"b{i}", r.choice(["CHALLENGE", "BLOCK", "ALLOW"]))
        + (f"10.0.0.{i % 4}", r.choice(["US", None]), r.choice([1, None]), r.choice(["failed", "passed"]), f"/p{i % 3}")
        for i in range(300)
    ]
    handle = jobs.stuffing_windows(folder + "/e", folder + "/w")
    for i in range(5):
        handle(spark.createDataFrame(data[i::5], schema), i)
    handle(spark.createDataFrame(data[1::5], schema), 1)
    stored = spark.read.parquet(folder + "/w").withColumnRenamed("bucket_time", "window_start")
    want = transforms.stuffing_counts(spark.createDataFrame(data, schema))
    assert rows(stored.select(*want.columns)) == rows(want)
    assert 0 < transforms.stuffing_alerts(stored, min_events=2).count() < stored.count()


MINUTE = (
    "bucket_time timestamp, tenant_id string, lb_namespace string, lb_name string, "
    "request_count bigint, blocked_count bigint, monitored_count bigint, error_count bigint, landed_at timestamp"
)


def test_hourly_rollup_recomputes_late_hours(spark, folder):
    minutes, hours, src = folder + "/m", folder + "/h", folder + "/in"
    handle = jobs.hourly_rollup(minutes, hours)

    def minute(m, n, landed=0):
        return (T0 + timedelta(minutes=m), "t", "n", "lb", n, 0, 0, n, T0 + timedelta(minutes=landed))

    # a value of nine is corrected to one, in one batch
    batches = [[minute(0, 1, 4), minute(0, 9, 2), minute(1, 2), minute(70, 5)], [minute(30, 4)], [minute(-60 * 30, 7)]]
    for data in batches:
        land(spark, src, data, MINUTE)
        jobs.run_available(stream(spark, src, MINUTE), handle, folder + "/progress")
    stored = spark.read.parquet(minutes).drop("bucket_date", "bucket_hour", "landed_at")
    assert rows(stored.filter(F.col("bucket_time") == F.lit(T0)).select("request_count")) == [(1,)]
    want = rollups.waf_rollup_1hour(stored)
    got = spark.read.parquet(hours).drop("bucket_date", "bucket_hour")
    assert rows(got) == rows(want) and got.count() == 3
    # a repeated batch changes nothing
    handle(spark.createDataFrame(batches[1], MINUTE), 99)
    assert rows(spark.read.parquet(hours).drop("bucket_date", "bucket_hour")) == rows(want)


def test_transition_log_over_shuffled_batches(spark, folder):
    schema = jobs.STATE_SCHEMA
    r = random.Random(7)
    data = [("t", "n", f"lb{i % 2}", r.choice("abc"), T0 + timedelta(minutes=37 * i), i) for i in range(150)]
    order = list(data)
    r.shuffle(order)
    handle = jobs.transition_log(folder + "/log")
    handle(spark.createDataFrame([], schema), 0)
    for i in range(4):
        handle(spark.createDataFrame(order[i::4], schema), i)
    # repeating a micro-batch gives the same log
    handle(spark.createDataFrame(order[1::4], schema), 1)
    cols = ["lb_name", "snapshot_id", "from_state", "to_state"]
    want = rows(state_transitions(spark.createDataFrame(data, schema)).select(*cols))
    assert rows(changes(spark.read.parquet(folder + "/log")).select(*cols)) == want
    assert spark.read.parquet(folder + "/log").count() == len(data)


def test_linked_rows_equal_one_batch_whatever_the_order(spark, folder):
    """Many small batches in any order, equal times, long gaps and repeats; the log equals that of all rows at once."""
    schema = jobs.STATE_SCHEMA
    r = random.Random(21)
    data = [("t", "n", f"lb{i % 3}", r.choice("abc"), T0 + timedelta(hours=r.choice([0, 1, 30, 31, 80, 200]), minutes=r.randint(0, 3)), i) for i in range(60)]
    r.shuffle(data)
    handle = jobs.transition_log(folder + "/log")
    for i in range(7):
        handle(spark.createDataFrame(data[i::7] + data[i::14], schema), i)
    cols = ["lb_name", "snapshot_id", "from_state", "to_state"]
    want = rows(state_transitions(spark.createDataFrame(data, schema)).select(*cols))
    log = spark.read.parquet(folder + "/log")
    assert rows(changes(log).select(*cols)) == want
    assert log.count() == len(data)


def test_transition_log_reads_no_older_days(spark, folder, monkeypatch):
    schema = jobs.STATE_SCHEMA
    handle = jobs.transition_log(folder + "/log")
    data = [("t", "n", "lb", "ab"[i % 2], T0 + timedelta(days=i), i) for i in range(0, 30, 3)]
    handle(spark.createDataFrame(data, schema), 0)
    read = []
    whole = tables.on_days
    monkeypatch.setattr(tables, "on_days", lambda t, c, d: read.append(list(d)) or whole(t, c, d))
    mark = [p.name for p in sorted((__import__("pathlib").Path(folder) / "log").iterdir())]
    handle(spark.createDataFrame([("t", "n", "lb", "c", T0 + timedelta(days=40), 40)], schema), 1)
    assert {d for days in read for d in days} == {(T0 + timedelta(days=40)).date()}
    read.clear()
    # a late row reads its own day and the next one with snapshots, and rewrites only these
    files = {f: f.stat().st_mtime_ns for f in (__import__("pathlib").Path(folder) / "log").glob("*/*.parquet")}
    handle(spark.createDataFrame([("t", "n", "lb", "d", T0 + timedelta(days=10), 100)], schema), 2)
    assert {d for days in read for d in days} == {(T0 + timedelta(days=n)).date() for n in (10, 12)}
    kept = {f for f in files if f.exists()}
    assert {f.parent.name for f in set(files) - kept} == {f"seen_date={(T0 + timedelta(days=12)).date()}"}
    assert len(mark) >= 10
    got = {r["snapshot_id"]: r["from_state"] for r in spark.read.parquet(folder + "/log").collect()}
    assert (got[100], got[12], got[40]) == ("b", "d", "b")


def test_a_late_snapshot_moves_the_transition(spark, folder):
    schema = jobs.STATE_SCHEMA

    def snap(i, state):
        return ("t", "n", "lb", state, T0 + timedelta(minutes=i), i)

    handle = jobs.transition_log(folder + "/log")
    for i, data in enumerate([[snap(0, "a"), snap(2, "b")], [snap(1, "b")]]):
        handle(spark.createDataFrame(data, schema), i)
    got = changes(spark.read.parquet(folder + "/log"))
    assert rows(got.select("snapshot_id", "from_state", "to_state")) == [(1, "a", "b")]


def test_refresh_replay_does_not_count_twice(spark, folder):
    from edgeline.operators import alerts

    schema = (
        EVENT + ", source_ip string, source_asn bigint, source_country string, url string, "
        "primary_signature string, response_code int"
    )

    def batch(minute, keys):
        rest = ("10.0.0.1", None, None, "/a", "S", 403)
        return spark.createDataFrame([event(minute, k) + rest for k in keys], schema)

    bots = batch(0, []).withColumn("endpoint_path", F.col("url"))
    empty_states = spark.createDataFrame([], "state_changed_at timestamp")
    paths = jobs.RefreshPaths(folder + "/e", folder + "/p", folder + "/a")

    def inputs(events):
        return alerts.Tables(
            waf_metrics=rollups.minute_metrics(events),
            waf_events=events,
            bot_events=bots,
            states=empty_states,
            endpoints=empty_states,
            certificates=empty_states,
        )

    rules = alerts.RuleSettings(
        enabled={"waf.block_burst"}, arguments={"waf.block_burst": {"threshold": 1}}
    )
    seen = []
    handle = jobs.profile_and_alert_refresh(paths, bots, inputs, rules, lambda counts, failed: seen.append((counts, failed)))
    handle(batch(0, []), 0)
    assert not tables.exists(spark, paths.alerts)
    handle(batch(0, ["a", "b"]), 0)
    handle(batch(2, ["c"]), 1)
    handle(batch(2, ["c"]), 1)
    got = tables.SnapshotTable(spark, paths.alerts, jobs.ALERT_SCHEMA).read()
    assert rows(got.select("dedupe_key", "occurrence_count")) == [("lb:n/lb", 2)]
    profile = tables.SnapshotTable(spark, paths.profiles, jobs.PROFILE_SCHEMA).read().first()
    assert profile["waf_block_count"] == 3 and profile["total_events"] == 6
    assert spark.read.parquet(paths.waf_events).count() == 3
    assert seen[0] == ({"waf.block_burst": 1}, [])
    # a late event neither narrows the profile nor moves the alert back
    before = tables.SnapshotTable(spark, paths.alerts, jobs.ALERT_SCHEMA).read().first()["last_seen_at"]
    handle(batch(-60, ["d"]), 2)
    profile = tables.SnapshotTable(spark, paths.profiles, jobs.PROFILE_SCHEMA).read().first()
    assert profile["waf_block_count"] == 4
    assert tables.SnapshotTable(spark, paths.alerts, jobs.ALERT_SCHEMA).read().first()["last_seen_at"] >= before
    assert merge.PROFILE_KEYS[0] == "tenant_id"


ATTACK = EVENT + ", source_ip string, source_asn bigint, source_country string, url string, primary_signature string, response_code int"
BOT_ATTACK = EVENT + ", source_ip string, source_asn bigint, source_country string, endpoint_path string"


def attacks(seed, n=160):
    r = random.Random(seed)
    who = [(f"10.0.0.{i % 9}", r.choice([None, 1]), r.choice([None, "US"])) for i in range(12)] + [(None, 1, "US"), ("", None, None)]
    waf = [
        event(r.randint(0, 3 * 1440), f"w{i}", r.choice(["BLOCK", "ALLOW", "MONITOR"]), f"lb{i % 3}")
        + r.choice(who) + (r.choice(["/a", "/b", "", None]), r.choice(["S", None]), r.choice([200, 403, None]))
        for i in range(n)
    ]
    bot = [
        event(r.randint(0, 3 * 1440), f"b{i}", r.choice(["CHALLENGE", "BLOCK", "ALLOW"]), f"lb{i % 2}") + r.choice(who) + (r.choice(["/a", "/c", None]),)
        for i in range(n)
    ]
    return waf, bot


def test_profiles_from_hours_equal_those_from_events(spark, folder):
    from pathlib import Path

    from edgeline.operators import security

    waf, bot = attacks(5)
    paths = jobs.AttackerPaths(*[f"{folder}/{n}" for n in ("waf", "bot", "hours", "profiles")], buckets=4)
    likes = [spark.createDataFrame([], ATTACK), spark.createDataFrame([], BOT_ATTACK)]
    handle = {k: jobs.attacker_hours(paths, k, *likes) for k in ("waf", "bot")}
    for i in range(3):
        handle["waf"](spark.createDataFrame(waf[i::3], ATTACK), i)
        handle["bot"](spark.createDataFrame(bot[i::3], BOT_ATTACK), i)
    handle["waf"](spark.createDataFrame(waf[1::3], ATTACK), 1)
    whole = [spark.createDataFrame(waf, ATTACK), spark.createDataFrame(bot, BOT_ATTACK)]
    hours = spark.read.parquet(paths.hours)
    cols = security.attacker_correlation(*whole, as_of=T0).columns
    for at, window in ((T0 + timedelta(days=9), timedelta(days=30)), (T0 + timedelta(hours=40, minutes=13), timedelta(hours=24)),
                       (T0 + timedelta(hours=30), timedelta(hours=6)), (T0 + timedelta(hours=30, minutes=50), timedelta(minutes=20))):
        got = security.attacker_correlation_from_hours(hours, *whole, as_of=at, window=window).select(*cols)
        assert rows(got) == rows(security.attacker_correlation(*whole, as_of=at, window=window))
    end = T0 + timedelta(days=4)
    window = {"window": timedelta(days=30)}
    jobs.refresh_profiles(spark, paths, end, *likes, **window)
    want = rows(security.attacker_correlation(*whole, as_of=end, **window))
    assert rows(spark.read.parquet(paths.profiles).select(*cols)) == want
    # one late event of one attacker: one partition of each table is written again
    files = {p: set((Path(p)).glob("**/*.parquet")) for p in (paths.hours, paths.profiles)}
    late = event(7, "late", "BLOCK", "lb9") + ("10.0.0.1", 1, "US", "/late", None, 403)
    handle["waf"](spark.createDataFrame([late], ATTACK), 9)
    jobs.refresh_profiles(spark, paths, end, *likes, **window)
    for p, depth in ((paths.hours, 2), (paths.profiles, 1)):
        now = set(Path(p).glob("**/*.parquet"))
        assert len({f.parent for f in (now ^ files[p])}) == 1, p
    whole[0] = spark.createDataFrame([*waf, late], ATTACK)
    assert rows(spark.read.parquet(paths.profiles).select(*cols)) == rows(security.attacker_correlation(*whole, as_of=end, **window))


def test_counted_hours_are_kept_once(spark, tmp_path, monkeypatch):
    """Only rows read from the table that is overwritten are kept beside the counted ones."""
    waf, bot = attacks(6)
    paths = jobs.AttackerPaths(*[f"{tmp_path}/{n}" for n in ("waf", "bot", "hours", "profiles")], buckets=4)
    likes = [spark.createDataFrame([], ATTACK), spark.createDataFrame([], BOT_ATTACK)]
    kept, cut = [], jobs.cut_lineage

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(jobs, "cut_lineage", counted)
    jobs.attacker_hours(paths, "waf", *likes)(spark.createDataFrame(waf, ATTACK), 0)
    assert sum(kept) == spark.read.parquet(paths.hours).count() > 0
