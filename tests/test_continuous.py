"""Windows from stored hours and finer rows behind the mark, against the events themselves."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from edgeline.operators import bot, continuous, rollups, tables, waf
from edgeline.streaming import jobs
from helpers import rows

T0 = datetime(2024, 5, 1)
EVENT = (
    "event_time timestamp, id string, tenant_id string, lb_namespace string, lb_name string, action string, "
    "landed_at timestamp"
)
LANDED = datetime(2024, 6, 1)


def events(seed, n=400, actions=("BLOCK", "ALLOW", "MONITOR")):
    """Two days of events; some exactly on minutes, hours and seconds."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + timedelta(microseconds=r.randrange(2 * 86_400_000_000))
        at = [at, at.replace(microsecond=0), at.replace(second=0, microsecond=0), at.replace(minute=0, second=0, microsecond=0)][i % 4]
        out.append((at, f"e{i}", f"t{r.randrange(3)}", "n", f"lb{r.randrange(4)}", r.choice(actions), LANDED))
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables filled by shuffled batches, late ones included."""
    folder = str(tmp_path_factory.mktemp("live"))
    data = events(1)
    paths = [f"{folder}/{x}" for x in ("events", "minutes", "hours")]
    handle = jobs.live_metrics(*paths)
    handle(spark.createDataFrame([], EVENT), 0)
    batches = [data[i::3] for i in range(3)]
    for i, batch in enumerate([*batches, batches[1]]):
        handle(spark.createDataFrame(batch, EVENT), i)
    tables_ = [spark.read.parquet(p) for p in paths]
    return spark.createDataFrame(data, EVENT), tables_, paths, continuous.mark(spark, paths[2])


def test_late_events_correct_stored_hours(stored):
    whole, (_, _, hours), _, mark = stored
    want = rollups.waf_rollup_1hour(rollups.minute_metrics(whole)).filter(F.col("bucket_time") < F.lit(mark).cast("timestamp"))
    assert rows(hours.select(*want.columns)) == rows(want)
    newest = max(e[0] for e in events(1))
    assert mark == (newest - timedelta(hours=1)).strftime("%Y-%m-%d %H:00:00")


def test_live_hours_equal_the_rollup_whatever_the_mark(stored):
    whole, (_, minutes, hours), _, mark = stored
    want = rows(rollups.waf_rollup_1hour(rollups.minute_metrics(whole)))
    for m in (mark, continuous.NO_HOURS, "2024-05-01 17:00:00"):
        assert rows(continuous.live_hours(hours, minutes, rollups.waf_rollup_1hour, mark=m)) == want


WINDOWS = [
    (T0 + timedelta(days=2), 2880),
    (T0 + timedelta(days=1, hours=20, minutes=30, seconds=17, microseconds=5), 1440),
    (T0 + timedelta(days=1), 60),
    (T0 + timedelta(days=1, minutes=7, seconds=30), 5),
    (T0 + timedelta(days=1, minutes=59, seconds=59, microseconds=999_999), 61),
    (T0 + timedelta(days=1, seconds=20), 1),
    (T0 + timedelta(hours=5), 10_080),
    (T0 - timedelta(hours=5), 60),
]


@pytest.mark.parametrize(("as_of", "minutes_back"), WINDOWS)
def test_windows_equal_the_events(stored, as_of, minutes_back):
    whole, (raw, minutes, hours), _, mark = stored
    back = timedelta(minutes=minutes_back)
    want = rows(waf.waf_overview(whole, as_of=as_of, minutes=minutes_back))
    for m in (mark, "2024-05-01 09:00:00"):
        counters = continuous.window_counters(hours, minutes, raw, rollups.minute_metrics, mark=m, as_of=as_of, back=back)
        assert rows(waf.waf_overview_of(counters)) == want
    points = continuous.window_points(minutes, raw, rollups.minute_metrics, as_of=as_of, back=back)
    if minutes_back % 60 == 0:
        want = waf.waf_sparkline(whole, as_of=as_of, hours=minutes_back // 60)
        assert rows(points.select(*want.columns)) == rows(want)


def test_whole_hours_need_neither_minutes_nor_events(stored):
    """Emptied of what the stored hours cover, minutes and events still give the same result."""
    whole, (raw, minutes, hours), _, mark = stored
    as_of = T0 + timedelta(days=1, hours=20, minutes=30, seconds=17)
    first, final = T0 + timedelta(hours=21), as_of.replace(minute=0, second=0)
    t = F.col("bucket_time")
    few = minutes.filter(((t >= first - timedelta(hours=1)) & (t < first)) | (t.between(final, as_of)))
    cut = raw.filter(
        F.col("event_time").between(as_of - timedelta(days=1), as_of - timedelta(days=1) + timedelta(seconds=43))
        | F.col("event_time").between(as_of.replace(second=0), as_of)
    )
    assert few.count() < minutes.count() / 5 and cut.count() < 10
    counters = continuous.window_counters(hours, few, cut, rollups.minute_metrics, mark=mark, as_of=as_of, back=timedelta(days=1))
    assert rows(waf.waf_overview_of(counters)) == rows(waf.waf_overview(whole, as_of=as_of, minutes=1440))


def test_load_balancers_idle_tenants_and_partition_filters(stored):
    whole, (raw, minutes, hours), _, mark = stored
    spark = whole.sparkSession
    as_of = T0 + timedelta(days=1, hours=3)
    lbs = spark.createDataFrame([("t0", "n", "lb1"), ("t1", "n", "lb2")], "tenant_id string, namespace string, name string")
    back = timedelta(hours=24)
    counters = continuous.window_counters(hours, minutes, raw, rollups.minute_metrics, mark=mark, as_of=as_of, back=back, lbs=lbs)
    tenants = spark.createDataFrame([("t0",), ("t1",), ("idle",)], "tenant_id string")
    from edgeline.operators.series import lb_filter

    want = waf.waf_overview(lb_filter(whole, lbs), as_of=as_of, minutes=1440, tenants=tenants)
    assert rows(waf.waf_overview_of(counters, tenants)) == rows(want)
    plan = counters._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:]]
    assert len(scans) == 3
    for scan in scans:
        filters = scan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
        assert "bucket_hour" in filters or "event_date" in filters
    assert all("Python" not in s and "CartesianProduct" not in s for s in (plan,))


def test_the_mark_moves_forward_only_and_a_repeat_changes_nothing(spark, stored):
    _, (_, _, hours), paths, mark = stored
    before = rows(hours)
    for at in (T0, T0 + timedelta(hours=30), datetime(1970, 1, 1)):
        assert continuous.advance(spark, paths[1], paths[2], rollups.waf_rollup_1hour, as_of=at) == mark
    # a job that died after writing its hours: the old mark stands, the repeat replaces them
    again = paths[2] + "_again"
    minutes = spark.read.parquet(paths[1])
    half = minutes.filter(F.col("bucket_time") < F.lit(T0 + timedelta(hours=9))).drop("bucket_date", "bucket_hour")
    tables.replace_buckets(rollups.waf_rollup_1hour(half), again)
    assert continuous.mark(spark, again) == continuous.NO_HOURS
    assert continuous.advance(spark, paths[1], again, rollups.waf_rollup_1hour, as_of=T0 + timedelta(days=3), lag_hours=0)
    want = rollups.waf_rollup_1hour(minutes)
    assert rows(spark.read.parquet(again).select(*want.columns)) == rows(want)
    assert rows(spark.read.parquet(paths[2])) == before


def test_bot_overview(spark, folder):
    data = events(2, 200, ("CHALLENGE", "BLOCK", "ALLOW"))
    paths = [f"{folder}/{x}" for x in "emh"]
    jobs.live_metrics(*paths, count=rollups.bot_minute_metrics, rollup=rollups.bot_rollup_1hour)(spark.createDataFrame(data, EVENT), 0)
    raw, minutes, hours = (spark.read.parquet(p) for p in paths)
    as_of = T0 + timedelta(days=1, hours=11, minutes=5, seconds=3)
    counters = continuous.window_counters(
        hours, minutes, raw, rollups.bot_minute_metrics, mark=continuous.mark(spark, paths[2]), as_of=as_of, back=timedelta(days=1)
    )
    want = bot.bot_overview(spark.createDataFrame(data, EVENT), as_of=as_of, minutes=1440)
    assert rows(bot.bot_overview_of(counters)) == rows(want)
