"""Micro-batch jobs: each applies batch operators to what has just arrived.

Progress logs and tables live in folders the caller names (shared storage). Rows
may come in any order and at any delay: a job stores what is new, then computes
the windows it touches again from the stored rows, so its tables equal one batch
run over all rows and nothing waits in state. A repeated micro-batch gives the
same tables: events are inserted only if absent, recomputed windows replace
themselves, and snapshot versions are numbered by batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeline import settings
from edgeline.functions.timewin import AsOf, bucket
from edgeline.operators import alerts as A
from edgeline.operators import continuous, merge, rollups, security, tables
from edgeline.operators.transitions import last_states, link_fresh
from edgeline.session import cut_lineage
from edgeline.sources.landing import partitions, write_partitioned
from edgeline.streaming import transforms

STATE_SCHEMA = (
    "tenant_id string, lb_namespace string, lb_name string, state string, "
    "seen_at timestamp, snapshot_id bigint"
)
PROFILE_SCHEMA = (
    "tenant_id string, source_ip string, source_asn bigint, source_country string, "
    "waf_block_count bigint, waf_monitor_count bigint, bot_block_count bigint, "
    "bot_challenge_count bigint, api_4xx_count bigint, top_endpoint string, "
    "top_signature string, distinct_lbs bigint, first_seen_at timestamp, "
    "last_seen_at timestamp, total_events bigint"
)
ALERT_SCHEMA = (
    "tenant_id string, rule_id string, dedupe_key string, severity string, status string, "
    "title string, description string, context string, occurrence_count bigint, "
    "first_seen_at timestamp, last_seen_at timestamp, acknowledged_at timestamp, "
    "resolved_at timestamp, last_batch_id bigint"
)


def run_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], progress: str
) -> StreamingQuery:
    """Process everything that has arrived, then stop; restart-safe through ``progress``.

    A batch is kept while it is handled, as the handlers read it several times;
    a lost block is computed again from the source.
    """

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(kept)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def append_available(stream: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Append a stream to a parquet table (the file sink commits each batch once)."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_events(path: str) -> Callable[[DataFrame, int], None]:
    """Append the events of a batch that the table lacks."""

    def handle(batch: DataFrame, _: int) -> None:
        tables.append_events(batch, path)

    return handle


def hourly_rollup(
    minute_path: str, hour_path: str, rollup=rollups.waf_rollup_1hour
) -> Callable[[DataFrame, int], None]:
    """Store the minute rows of a batch, then recompute the hours they fall into.

    Late rows only cost the hours they touch. Of two values of one minute the
    one landed later counts.
    """

    def handle(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        tables.upsert_buckets(batch, minute_path, merge.METRIC_KEYS)
        continuous.refresh_hours(batch, minute_path, hour_path, rollup)

    return handle


def _store_minutes(batch: DataFrame, event_path: str, minute_path: str, count) -> DataFrame:
    """Store the events of a batch and count the minutes they fall into again; returns these minutes."""
    tables.append_events(batch, event_path)
    minutes = batch.select(bucket("event_time", "1 minute").alias("bucket_time")).distinct()
    events = batch.sparkSession.read.parquet(event_path)
    events = tables.on_days(events, "event_time", tables.days_of(minutes, "bucket_time"))
    events = events.withColumn("bucket_time", bucket("event_time", "1 minute"))
    events = events.join(minutes, "bucket_time", "left_semi").drop("bucket_time")
    tables.replace_buckets(count(events), minute_path)
    return minutes


def event_metrics(
    event_path: str, minute_path: str, hour_path: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Store the events of a batch, then count the minutes, and the hours, they fall into again."""

    def handle(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        minutes = _store_minutes(batch, event_path, minute_path, rollups.minute_metrics)
        if hour_path:
            continuous.refresh_hours(minutes, minute_path, hour_path, rollups.waf_rollup_1hour)

    return handle


def live_metrics(
    event_path: str,
    minute_path: str,
    hour_path: str,
    count=rollups.minute_metrics,
    rollup=rollups.waf_rollup_1hour,
    lag_hours: int = settings.ROLLUP_LAG_HOURS,
) -> Callable[[DataFrame, int], None]:
    """As ``event_metrics``, but an hour is stored once, when it lies ``lag_hours`` behind the newest event.

    Late events recompute the stored hours they fall into; ``continuous`` reads the rest from the minutes.
    """

    def handle(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        minutes = _store_minutes(batch, event_path, minute_path, count)
        continuous.correct(minutes, minute_path, hour_path, rollup)
        newest = tables.newest(batch, "event_time")
        continuous.advance(batch.sparkSession, minute_path, hour_path, rollup, as_of=newest, lag_hours=lag_hours)

    return handle


def stuffing_windows(
    event_path: str, window_path: str, width: str = "10 minutes", slide: str = "5 minutes"
) -> Callable[[DataFrame, int], None]:
    """Store the bot events of a batch, then count the sliding windows they fall into again.

    The table holds the counts of every group; ``transforms.stuffing_alerts``
    applies the rule's thresholds, so a group may come and go as rows arrive.
    """

    def handle(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        tables.append_events(batch, event_path)
        touched = batch.select(F.window("event_time", width, slide)["start"].alias("bucket_time")).distinct()
        events = batch.sparkSession.read.parquet(event_path)
        # a window may reach into the days after its start; an hour and a day at a time none is skipped
        reach = F.explode(F.sequence("bucket_time", F.col("bucket_time") + F.expr(f"INTERVAL {width}"), F.expr("INTERVAL 1 HOUR")))
        reach = touched.select(reach.alias("at"), (F.col("bucket_time") + F.expr(f"INTERVAL {width}")).alias("end"))
        events = tables.on_days(events, "event_time", tables.days_of(reach, "at", "end"))
        counted = transforms.stuffing_counts(events, width=width, slide=slide)
        counted = counted.withColumnRenamed("window_start", "bucket_time")
        tables.replace_buckets(counted.join(touched, "bucket_time", "left_semi"), window_path)

    return handle


HEAD_SCHEMA = "tenant_id string, lb_namespace string, lb_name string, seen_date date"


def transition_log(path: str) -> Callable[[DataFrame, int], None]:
    """Keep every snapshot with the state before it; ``transitions.changes`` of the table is the log.

    Two small tables are kept beside it: ``-last`` holds the newest snapshot of
    each load balancer, ``-days`` the days on which each has snapshots,
    partitioned by day. Of the log a batch reads its own days and, for load
    balancers with late rows, the next day on which they have any: the snapshot
    after a late one tells what came before it, so older days are never read.
    A batch that changes no stored snapshot is appended; otherwise the days with
    changes are rewritten. A snapshot that is stored already is left out, and the
    small tables are merged from whole batches, so a repeated batch gives the
    same tables.
    """
    key = ["snapshot_id", *merge.LB_KEYS]
    day = F.col("seen_at").cast("date")

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c != "from_state"]
        batch = merge.one_per_key(batch.select(*cols), key, F.col("seen_at"), newest=False)
        like = batch.withColumn("from_state", F.lit(None).cast("string")).withColumns(partitions("seen_at"))
        log = tables.read(spark, path, like)
        latest = tables.SnapshotTable(spark, path + "-last", STATE_SCHEMA)
        last = latest.read(before=batch_id)
        heads = tables.read(spark, path + "-days", spark.createDataFrame([], HEAD_SCHEMA))

        mine = batch.select(*merge.LB_KEYS, day.alias("seen_date")).distinct()
        late = batch.join(last.select(*merge.LB_KEYS, F.col("seen_at").alias("__last")), merge.LB_KEYS)
        late = late.filter(F.col("seen_at") <= F.col("__last")).select(*merge.LB_KEYS, day.alias("__day")).distinct()
        # the first day with snapshots after each day of a late row
        oldest = late.agg(F.min("__day")).first()[0]
        after = heads.filter(F.col("seen_date") > F.lit(oldest)) if oldest else heads.limit(0)
        after = late.join(after, merge.LB_KEYS).filter(F.col("seen_date") > F.col("__day"))
        after = after.groupBy(*merge.LB_KEYS, "__day").agg(F.min("seen_date").alias("seen_date"))
        reads = cut_lineage(mine.unionByName(after.select(*mine.columns)).distinct())
        days = tables.days_of(reads, "seen_date")
        stored = tables.on_days(log, "seen_at", days)
        near = stored.join(reads, [*merge.LB_KEYS, "seen_date"], "left_semi").select(*cols, "from_state")
        fresh = batch.join(near.select(*key), key, "left_anti")
        linked = cut_lineage(link_fresh(near, fresh, last))
        rows = linked.drop("fresh")
        if linked.filter(~F.col("fresh")).isEmpty():
            write_partitioned(rows, path, "seen_at")
        else:
            whole = tables.on_days(log, "seen_at", tables.days_of(rows, "seen_at"))
            others = whole.join(rows.select(*key), key, "left_anti").select(*rows.columns)
            write_partitioned(cut_lineage(rows.unionByName(others)), path, "seen_at", mode="overwrite")

        known = tables.on_days(heads, "seen_at", tables.days_of(mine, "seen_date")).select(*mine.columns)
        new_heads = mine.join(known, mine.columns, "left_anti")
        new_heads.coalesce(1).write.mode("append").partitionBy("seen_date").parquet(path + "-days")
        newest = last_states(last.unionByName(batch.select(*last.columns)))
        latest.write(newest.select(*last.columns), version=batch_id)

    return handle


@dataclass
class RefreshPaths:
    """Tables kept by the refresh job."""

    waf_events: str
    profiles: str
    alerts: str


def profile_and_alert_refresh(
    paths: RefreshPaths,
    bot_events: DataFrame,
    others: Callable[[DataFrame], A.Tables],
    rules: A.RuleSettings | None = None,
    report: Callable[[dict[str, int], list[str]], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """After each ingest: store the events, renew profiles, evaluate the rules.

    ``others`` gives the rule inputs for the stored events. Both refreshes run
    as of the newest stored event, whatever the batch holds, fetched once per
    batch (one value) so that it prunes the scans as a literal. Rules that
    failed are logged and, where ``report`` is given, handed to it with the
    number of candidates of each rule.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        profiles = tables.SnapshotTable(spark, paths.profiles, PROFILE_SCHEMA)
        alerts = tables.SnapshotTable(spark, paths.alerts, ALERT_SCHEMA)
        tables.append_events(batch, paths.waf_events)
        if not tables.exists(spark, paths.waf_events):
            return
        events = spark.read.parquet(paths.waf_events)
        last_day = events.filter(F.col("event_date") == events.agg(F.max("event_date")).scalar())
        now = tables.newest(last_day, "event_time")
        found = security.attacker_correlation(events, bot_events, as_of=now)
        profiles.write(
            merge.attacker_profile_merge(profiles.read(before=batch_id), found), version=batch_id
        )
        cycle = A.evaluate_and_merge(
            alerts.read(before=batch_id), others(events), now, rules, batch_id
        )
        alerts.write(cycle.alerts, version=batch_id)
        if report:
            report(cycle.counts, cycle.failed)

    return handle


@dataclass
class AttackerPaths:
    """Tables kept for attacker profiles; ``hours`` and ``profiles`` are cut into ``buckets`` by attacker."""

    waf_events: str
    bot_events: str
    hours: str
    profiles: str
    buckets: int = 64


def _attacker() -> Column:
    """A hash of the attacker in which a null and a text never meet."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in security.ATTACKER])


def _bucket_of(buckets: int) -> Column:
    return F.pmod(_attacker(), F.lit(buckets)).cast("int")


def attacker_hours(paths: AttackerPaths, kind: str, waf_like: DataFrame, bot_like: DataFrame) -> Callable[[DataFrame, int], None]:
    """Store the events of a batch (``kind``: ``waf`` or ``bot``), then count again the hours of the attackers it holds.

    Only the events of the batch's days are read, of them only the attackers and
    hours it touches are counted, and only the partitions (day, bucket) of these are
    rewritten. Counts come from the stored events, so a repeated batch changes
    nothing and late rows find their hour. ``waf_like`` and ``bot_like`` give the
    columns of an event table that is not written yet.
    """

    def handle(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        tables.append_events(batch, paths.waf_events if kind == "waf" else paths.bot_events)
        hour = bucket("event_time", "1 hour").alias("signal_hour")
        touched = batch.filter(security.known_address()).select(hour, _attacker().alias("attacker")).distinct()
        days = tables.days_of(touched, "signal_hour")
        key = ["signal_hour", "attacker"]

        def again(path: str, like: DataFrame) -> DataFrame:
            rows = tables.on_days(tables.read(spark, path, like.withColumns(partitions("event_time"))), "event_time", days)
            rows = rows.select("*", hour, _attacker().alias("attacker"))
            return rows.join(touched, key, "left_semi").select(*like.columns)

        fresh = security.attacker_hours(again(paths.waf_events, waf_like), again(paths.bot_events, bot_like))
        fresh = cut_lineage(
            fresh.withColumns({"signal_date": F.col("signal_hour").cast("date"), "bucket": _bucket_of(paths.buckets)})
        )
        if fresh.isEmpty():
            return
        stored = tables.on_days(tables.read(spark, paths.hours, fresh), "signal_hour", days)
        parts = ["signal_date", "bucket"]
        stored = stored.join(fresh.select(*parts).distinct(), parts, "left_semi").withColumn("attacker", _attacker())
        kept = stored.join(touched, key, "left_anti").select(*fresh.columns)
        _write_buckets(cut_lineage(kept).unionByName(fresh), paths.hours, parts)

    return handle


def _write_buckets(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Replace the partitions that ``rows``, which may not be read from the table itself, fall into, and no others."""
    (
        rows.hint("rebalance", *[F.col(p) for p in parts])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def refresh_profiles(spark: SparkSession, paths: AttackerPaths, as_of: AsOf, waf_like: DataFrame, bot_like: DataFrame, **window) -> None:
    """Merge the window's profiles into the table; only buckets in which a profile changed are rewritten.

    The merge replaces counters and widens the times seen, so repeating it changes nothing.
    """
    events = [
        tables.read(spark, path, like.withColumns(partitions("event_time")))
        for path, like in ((paths.waf_events, waf_like), (paths.bot_events, bot_like))
    ]
    found = security.attacker_correlation_from_hours(spark.read.parquet(paths.hours), *events, as_of=as_of, **window)
    like = found.withColumn("bucket", _bucket_of(paths.buckets))
    stored = tables.read(spark, paths.profiles, like)
    merged = cut_lineage(
        merge.attacker_profile_merge(stored.drop("bucket"), found.select(*[c for c in stored.columns if c != "bucket"]))
        .withColumn("bucket", _bucket_of(paths.buckets))
        .select(*stored.columns)
    )
    changed = merged.exceptAll(stored).select("bucket").distinct()
    rows = merged.join(cut_lineage(changed), "bucket", "left_semi")
    if not rows.isEmpty():
        _write_buckets(rows, paths.profiles, ["bucket"])
