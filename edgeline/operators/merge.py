"""Idempotent merges of a batch into a target table.

Every function takes and returns DataFrames; ``tables`` writes the result. One
row per key is chosen by aggregation, not by a window, so map tasks already
collapse copies and a key with very many copies never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions.timewin import AsOf

LB_KEYS = ["tenant_id", "lb_namespace", "lb_name"]
# records without an identifier get a digest of a few fields, so the owner is part of the key
EVENT_KEYS = ["event_time", "id", *LB_KEYS]
METRIC_KEYS = ["bucket_time", *LB_KEYS]
API_METRIC_KEYS = [*METRIC_KEYS, "method", "endpoint_path"]
OBJECT_KEYS = ["tenant_id", "namespace", "name"]
PROFILE_KEYS = ["tenant_id", "source_ip", "source_asn", "source_country"]
ALERT_KEYS = ["tenant_id", "rule_id", "dedupe_key"]


def one_per_key(df: DataFrame, keys: list[str], order: Column, *, newest: bool) -> DataFrame:
    """The first or last row of each key in the given order; a digest of the row decides ties."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("__row"))
        .select(*[c if c in keys else F.col("__row")[c].alias(c) for c in df.columns])
    )


def new_rows(
    target: DataFrame, batch: DataFrame, keys: list[str], order: Column
) -> DataFrame:
    """Batch rows whose key the target lacks; the first of equal keys is kept."""
    return one_per_key(batch, keys, order, newest=False).join(
        target.select(*keys), keys, "left_anti"
    )


def insert_if_absent(
    target: DataFrame, batch: DataFrame, keys: list[str], order: Column
) -> DataFrame:
    """Event append: an existing row wins over a repeated one."""
    return target.unionByName(new_rows(target, batch, keys, order))


def upsert_overwrite(
    target: DataFrame, batch: DataFrame, keys: list[str], order: Column
) -> DataFrame:
    """The newest batch row replaces every column of the row with its key.

    An anti join against the (usually small) batch lets AQE broadcast the batch
    keys, so the target is not shuffled.
    """
    newest = one_per_key(batch, keys, order, newest=True)
    kept = target.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest)


def snapshot_upsert(
    target: DataFrame, batch: DataFrame, keys: list[str], sync_ts: AsOf, order: Column
) -> DataFrame:
    """Current-state upsert; refreshed rows carry the start of the sync."""
    at = sync_ts if isinstance(sync_ts, Column) else F.lit(sync_ts)
    stamped = batch.withColumn("last_seen_at", at.cast(target.schema["last_seen_at"].dataType))
    return upsert_overwrite(target, stamped, keys, order)


def reap_stale(
    target: DataFrame,
    sync_ts: AsOf,
    ok_scopes: DataFrame,
    scope: list[str],
    seen_col: str = "last_seen_at",
) -> DataFrame:
    """Drop rows the sync did not refresh, only in scopes it listed successfully."""
    at = sync_ts if isinstance(sync_ts, Column) else F.lit(sync_ts)
    stale = F.coalesce(F.col(seen_col) < at.cast(target.schema[seen_col].dataType), F.lit(False))
    ok = ok_scopes.select(*scope).distinct().withColumn("__ok", F.lit(True))
    return (
        target.join(ok, scope, "left")
        .filter(~(F.coalesce(F.col("__ok"), F.lit(False)) & stale))
        .select(*target.columns)
    )


def scopes_with_success(listings: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes in which at least one source was listed; none when all failed."""
    return listings.filter("ok").select(*scope).distinct()


def reap_stale_per_parent(
    target: DataFrame, refreshed_lbs: DataFrame, sync_ts: AsOf, seen_col: str = "updated_at"
) -> DataFrame:
    """``reap_stale`` scoped to the load balancers whose pull succeeded."""
    return reap_stale(target, sync_ts, refreshed_lbs, LB_KEYS, seen_col)


def cascade_delete(child: DataFrame, parents: DataFrame, on: dict[str, str]) -> DataFrame:
    """Children of surviving parents; ``on`` maps child columns to parent columns."""
    keys = parents.select(*[F.col(p).alias(c) for c, p in on.items()])
    return child.join(keys, list(on), "left_semi")


def attacker_profile_merge(profiles: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace counters and top values, widen first/last seen, keep absent profiles.

    Grouping treats a null ASN or country as equal, which a plain key join would not.
    """
    times = ["first_seen_at", "last_seen_at"]
    rest = [c for c in profiles.columns if c not in PROFILE_KEYS + times]
    both = profiles.withColumn("__new", F.lit(0)).unionByName(
        batch.select(*profiles.columns).withColumn("__new", F.lit(1))
    )
    merged = both.groupBy(*PROFILE_KEYS).agg(
        F.max_by(F.struct(*rest), F.col("__new")).alias("__row"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    return merged.select(
        *[c if c in PROFILE_KEYS + times else F.col("__row")[c].alias(c) for c in profiles.columns]
    )


def alert_merge(
    alerts: DataFrame, candidates: DataFrame, now: AsOf, batch_id: int | None = None
) -> DataFrame:
    """Fold candidates into the alerts table.

    Text and severity are replaced, the count grows by the number of candidates,
    first_seen, status and ack/resolve times stay. With ``batch_id`` a repeated
    micro-batch changes nothing, as each alert remembers the last one applied.
    """
    at = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    texts = ["severity", "title", "description", "context"]
    fresh = candidates.groupBy(*ALERT_KEYS).agg(
        F.count("*").alias("n"),
        F.max_by(
            F.struct(*texts), F.struct("ord", "title", "description", "context")
        ).alias("c"),
    )
    j = alerts.join(fresh, ALERT_KEYS, "full_outer")
    hit = F.col("n").isNotNull()
    if batch_id is not None:
        hit &= F.coalesce(F.col("last_batch_id") < batch_id, F.lit(True))
    known = F.col("occurrence_count").isNotNull()
    cols = {
        **{t: F.when(hit, F.col("c")[t]).otherwise(F.col(t)) for t in texts},
        "status": F.coalesce("status", F.lit("open")),
        "occurrence_count": F.when(
            hit, F.coalesce("occurrence_count", F.lit(0)) + F.col("n")
        ).otherwise(F.col("occurrence_count")),
        "first_seen_at": F.when(known, F.col("first_seen_at")).otherwise(at),
        "last_seen_at": F.when(hit, at).otherwise(F.col("last_seen_at")),
    }
    if "last_batch_id" in alerts.columns:
        mark = F.lit(batch_id).cast("bigint")
        cols["last_batch_id"] = F.when(hit, mark).otherwise(F.col("last_batch_id"))
    return j.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in alerts.columns])


def alert_transition(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply acknowledge / resolve / reopen actions (``action``, ``at``) to alerts.

    Only what follows the last reopen counts, so the outcome is a set of
    aggregates instead of a per-alert replay. Actions at one instant apply in
    the order reopen, acknowledge, resolve.
    """
    order = (
        F.when(F.col("action") == "reopen", 0).when(F.col("action") == "acknowledge", 1).otherwise(2)
    )
    state = {"reopen": "open", "acknowledge": "acknowledged", "resolve": "resolved"}
    status = F.coalesce(*[F.when(F.col("action") == a, F.lit(s)) for a, s in state.items()])
    reopened = actions.groupBy(*ALERT_KEYS).agg(
        F.max(F.when(F.col("action") == "reopen", F.col("at"))).alias("__reopened"),
        F.max_by(status, F.struct(F.col("at"), order)).alias("__status"),
    )
    later = F.col("__reopened").isNull() | (F.col("at") >= F.col("__reopened"))
    outcome = (
        actions.join(reopened, ALERT_KEYS)
        .groupBy(*ALERT_KEYS)
        .agg(
            F.first("__status").alias("__status"),
            F.first("__reopened").alias("__reopened"),
            F.min(F.when(later & (F.col("action") != "reopen"), F.col("at"))).alias("__ack"),
            F.max(F.when(later & (F.col("action") == "resolve"), F.col("at"))).alias("__res"),
        )
    )
    wiped = F.col("__reopened").isNotNull()
    cols = {
        "status": F.coalesce("__status", "status"),
        "acknowledged_at": F.when(wiped, F.col("__ack")).otherwise(
            F.coalesce("acknowledged_at", "__ack")
        ),
        "resolved_at": F.when(wiped, F.col("__res")).otherwise(F.coalesce("__res", "resolved_at")),
    }
    j = alerts.join(outcome, ALERT_KEYS, "left")
    return j.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in alerts.columns])
