"""Streaming jobs run to completion over the event table.

The source is a file stream, the trigger ``availableNow``; the result is the
stored table, with every window of every event.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.operators import alerts, rollups, tables
from edgeline.operators.transitions import changes, state_transitions
from edgeline.plans.alert_queries import ALL_RULES, RULE_VIEWS, RULES, SHIFTED
from edgeline.plans.alert_queries import tables as rule_tables
from edgeline.plans.event_queries import HOUR, SECURITY_VIEWS, SIGNALS, count_if, sums
from edgeline.plans.payloads import landed
from edgeline.plans.registry import query
from edgeline.plans.views import Views, nth
from edgeline.session import scratch_path
from edgeline.streaming import jobs, transforms

class StreamViews(Views):
    """The event views over a file stream instead of a table."""

    def __init__(self, v: Views):
        super().__init__(v.spark, v.sf_dir)
        self.batch = v

    def table(self, name: str) -> DataFrame:
        schema = self.batch.table(name).schema
        source = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        return source.parquet(self.sf_dir)


def timed(df: DataFrame) -> DataFrame:
    """Event times as zoned timestamps, the type watermarks work on."""
    return df.withColumn("event_time", F.col("event_time").cast("timestamp"))


def event_stream(v: Views, minute: int = 0) -> DataFrame:
    return timed(StreamViews(v).waf_events).withColumn("landed_at", landed(minute))


def pulled_twice(v: Views) -> DataFrame:
    """Two overlapping pulls: every event arrives twice."""
    both = event_stream(v).unionByName(event_stream(v, 5))
    return transforms.overlapping_pull(both)


@query(
    "dedup_stream",
    """SELECT tenant_id, lb_namespace, x.n || lb_name AS lb_name, count(*) AS events
FROM waf_events, (VALUES (''), ('also-')) x(n) GROUP BY ALL""",
    ["waf_events"],
)
def _(v):
    path = scratch_path(v.spark, "dedup")
    # every event has a twin of another owner with the same time and identifier
    name = F.explode(F.array(F.col("lb_name"), F.concat(F.lit("also-"), "lb_name")))
    pulled = pulled_twice(v).withColumn("lb_name", name)
    jobs.append_available(transforms.dedup_stream(pulled), path, path + "-progress")
    stored = v.spark.read.parquet(path)
    return stored.groupBy("tenant_id", "lb_namespace", "lb_name").agg(F.count("*").alias("events"))


@query(
    "overlapping_pull",
    "SELECT id, event_time, tenant_id, action FROM waf_events",
    ["waf_events"],
)
def _(v):
    path = scratch_path(v.spark, "events")
    jobs.run_available(pulled_twice(v), jobs.ingest_events(path), path + "-progress")
    return v.spark.read.parquet(path).select("id", "event_time", "tenant_id", "action")


@query("minute_metrics_stream", "SELECT * FROM waf_metrics", ["waf_metrics"])
def _(v):
    base = scratch_path(v.spark, "minutes")
    job = jobs.event_metrics(base + "-events", base + "-minutes")
    jobs.run_available(pulled_twice(v), job, base + "-progress")
    return v.spark.read.parquet(base + "-minutes").drop("bucket_date", "bucket_hour")


@query(
    "hourly_rollup_stream",
    f"""SELECT {HOUR} AS bucket_time, tenant_id, lb_namespace, lb_name,
  {sums("request_count", "blocked_count", "monitored_count", "error_count")}
FROM waf_metrics GROUP BY ALL""",
    ["waf_metrics"],
)
def _(v):
    base = scratch_path(v.spark, "rollup")
    job = jobs.event_metrics(base + "-events", base + "-minutes", base + "-hours")
    jobs.run_available(pulled_twice(v), job, base + "-progress")
    return v.spark.read.parquet(base + "-hours").drop("bucket_date", "bucket_hour")


@query(
    "cred_stuffing_stream",
    f"""SELECT w AS window_start, w + INTERVAL '60 minutes' AS window_end, tenant_id, source_ip, source_country, source_asn,
  count(*) AS total, {count_if("challenge_result = 'failed'", "failed")}, max(endpoint_path) AS any_endpoint
FROM (SELECT *, time_bucket(INTERVAL '30 minutes', event_time) - o * INTERVAL '30 minutes' AS w
      FROM bot_events, (VALUES (0), (1)) x(o)) WHERE source_ip IS NOT NULL AND action IN ('CHALLENGE', 'BLOCK')
GROUP BY ALL HAVING count(*) >= 1 AND count(*) FILTER (challenge_result = 'failed') * 100.0 >= count(*) * 30.0""",
    ["bot_events"],
)
def _(v):
    bots = timed(StreamViews(v).bot_events).withColumn("landed_at", landed())
    base = scratch_path(v.spark, "stuffing")
    job = jobs.stuffing_windows(base + "-events", base + "-windows", width="60 minutes", slide="30 minutes")
    jobs.run_available(bots, job, base + "-progress")
    stored = v.spark.read.parquet(base + "-windows").drop("bucket_date", "bucket_hour")
    found = transforms.stuffing_alerts(stored, min_events=1, failure_pct=30.0)
    return found.withColumnRenamed("bucket_time", "window_start")


def snapshots(df: DataFrame) -> DataFrame:
    """Learning-state snapshots: one per event of a load balancer."""
    return df.select(
        "tenant_id",
        "lb_namespace",
        "lb_name",
        nth(["learning", "mature", "enforcing"], F.floor(F.col("value") / 20) % 3).alias("state"),
        F.col("event_time").cast("timestamp").alias("seen_at"),
        F.col("event_id").alias("snapshot_id"),
    )


TRANSITIONS = """SELECT tenant_id, lb_namespace, lb_name, event_id AS snapshot_id, p AS from_state, state AS to_state,
  event_time AS changed_at FROM (SELECT *, lag(state) OVER (PARTITION BY tenant_id, lb_namespace, lb_name
    ORDER BY event_time, event_id) AS p FROM (SELECT *, CASE CAST(floor(value / 20) AS BIGINT) % 3 WHEN 0 THEN 'learning'
    WHEN 1 THEN 'mature' ELSE 'enforcing' END AS state FROM waf_events)) WHERE p <> state"""


@query("state_transitions", TRANSITIONS, ["waf_events"])
def _(v):
    return state_transitions(snapshots(v.waf_events))


@query("state_transition_log", TRANSITIONS, ["waf_events"])
def _(v):
    base = scratch_path(v.spark, "transitions")
    stream = snapshots(StreamViews(v).waf_events)
    jobs.run_available(stream, jobs.transition_log(base), base + "-progress")
    return changes(v.spark.read.parquet(base))


def refreshed(v: Views) -> tuple[str, str]:
    """Run the refresh job over the event stream; returns the profile and alert tables."""
    base = scratch_path(v.spark, "refresh")
    paths = jobs.RefreshPaths(base + "-events", base + "-profiles", base + "-alerts")

    def inputs(events: DataFrame) -> alerts.Tables:
        return replace(
            rule_tables(v), waf_metrics=rollups.minute_metrics(events), waf_events=events, bot_events=timed(v.bot_events)
        )

    job = jobs.profile_and_alert_refresh(paths, timed(v.bot_events), inputs, RULES)
    jobs.run_available(event_stream(v), job, base + "-progress")
    return paths.profiles, paths.alerts


@query(
    "profile_and_alert_refresh",
    f"WITH {SIGNALS.format(h=24)} SELECT * FROM profiles",
    SECURITY_VIEWS,
)
def _(v):
    profiles, _ = refreshed(v)
    return tables.SnapshotTable(v.spark, profiles, jobs.PROFILE_SCHEMA).read()


@query(
    "incremental_profiles",
    f"WITH {SIGNALS.format(h=24)} SELECT * FROM profiles",
    SECURITY_VIEWS,
)
def _(v):
    """Hourly counts kept by two streams, then the profiles of the last day merged from them."""
    base = scratch_path(v.spark, "attackers")
    paths = jobs.AttackerPaths(*[f"{base}-{name}" for name in ("waf", "bot", "hours", "profiles")], buckets=8)
    waf, bot = event_stream(v), timed(StreamViews(v).bot_events).withColumn("landed_at", landed())
    likes = [v.spark.createDataFrame([], s.schema) for s in (waf, bot)]
    for kind, source in (("waf", waf), ("bot", bot)):
        jobs.run_available(source, jobs.attacker_hours(paths, kind, *likes), f"{base}-{kind}-progress")
    now = tables.newest(v.spark.read.parquet(paths.waf_events), "event_time")
    jobs.refresh_profiles(v.spark, paths, now, *likes)
    return v.spark.read.parquet(paths.profiles).drop("bucket")


@query(
    "alert_refresh",
    f"""WITH {SHIFTED} SELECT tenant_id, rule_id, CAST(count(*) AS BIGINT) AS alerts FROM (
  SELECT tenant_id, rule_id FROM ({ALL_RULES})) GROUP BY ALL""",
    RULE_VIEWS,
)
def _(v):
    _, path = refreshed(v)
    stored = tables.SnapshotTable(v.spark, path, jobs.ALERT_SCHEMA).read()
    return stored.groupBy("tenant_id", "rule_id").agg(F.sum("occurrence_count").alias("alerts"))
