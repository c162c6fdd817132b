"""Windows answered from stored hours, minutes behind the mark and events in cut minutes.

Each query lets the stream fill its tables, and has the SQL of the query that
reads the events themselves.
"""

from __future__ import annotations

from datetime import timedelta

from edgeline.operators import api, bot, continuous, rollups, waf
from edgeline.plans.event_queries import HOUR, sums
from edgeline.plans.payloads import landed
from edgeline.plans.registry import ORACLES, QUERIES, query
from edgeline.plans.stream_queries import StreamViews, event_stream, timed
from edgeline.session import scratch_path
from edgeline.sources.landing import write_partitioned
from edgeline.streaming import jobs

DAY, WEEK = timedelta(days=1), timedelta(days=7)


def same_rows(name: str, like: str):
    """Register a query that returns the rows of another one."""

    def register(build):
        QUERIES[name] = build
        ORACLES[name] = ORACLES[like]
        return build

    return register


class Live:
    """Event, minute and hour tables kept by a stream, and the mark of the hours."""

    def __init__(self, v, source, **kinds):
        base = scratch_path(v.spark, "live")
        paths = [f"{base}-{x}" for x in ("events", "minutes", "hours")]
        jobs.run_available(source, jobs.live_metrics(*paths, **kinds), f"{base}-progress")
        self.mark = continuous.mark(v.spark, paths[2])
        self.events, self.minutes, self.hours = (v.spark.read.parquet(p) for p in paths)


def firewall(v) -> Live:
    return Live(v, event_stream(v))


@same_rows("waf_overview_live", "waf_overview")
def _(v):
    t = firewall(v)
    return waf.waf_overview_of(
        continuous.window_counters(
            t.hours, t.minutes, t.events, rollups.minute_metrics, mark=t.mark, as_of=v.as_of, back=DAY
        )
    )


@same_rows("waf_sparkline_live", "waf_sparkline")
def _(v):
    t = firewall(v)
    return continuous.window_points(t.minutes, t.events, rollups.minute_metrics, as_of=v.as_of, back=WEEK)


@query(
    "waf_hours_live",
    f"""SELECT {HOUR} AS bucket_time, tenant_id, lb_namespace, lb_name,
  {sums("request_count", "blocked_count", "monitored_count", "error_count")} FROM waf_metrics GROUP BY ALL""",
    ["waf_metrics"],
)
def _(v):
    t = firewall(v)
    return continuous.live_hours(t.hours, t.minutes, rollups.waf_rollup_1hour, mark=t.mark)


@same_rows("bot_overview_live", "bot_overview")
def _(v):
    source = timed(StreamViews(v).bot_events).withColumn("landed_at", landed())
    t = Live(v, source, count=rollups.bot_minute_metrics, rollup=rollups.bot_rollup_1hour)
    return bot.bot_overview_of(
        continuous.window_counters(
            t.hours, t.minutes, t.events, rollups.bot_minute_metrics, mark=t.mark, as_of=v.as_of, back=DAY
        )
    )


@same_rows("api_overview_live", "api_overview")
def _(v):
    base = scratch_path(v.spark, "traffic")
    minute_path, hour_path = f"{base}-minutes", f"{base}-hours"
    write_partitioned(v.api_metrics, minute_path, "bucket_time")
    mark = continuous.advance(v.spark, minute_path, hour_path, rollups.api_traffic_1hour, as_of=v.as_of)
    metrics, hours = v.spark.read.parquet(minute_path), v.spark.read.parquet(hour_path)
    traffic = continuous.window_traffic(hours, metrics, mark=mark, as_of=v.as_of, minutes=7 * 1440)
    return api.api_overview_of(v.api_endpoints, v.states, traffic)
