"""State changes in a series of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LB_KEYS = ["tenant_id", "lb_namespace", "lb_name"]


def with_previous(snapshots: DataFrame, seq: str = "seen_at", slot: str = "hour") -> DataFrame:
    """Every snapshot with the state of the one before as ``from_state``, null for the first.

    ``lag`` runs within (load balancer, time slot), so one load balancer with a
    third of all snapshots is spread over its slots. The first row of a slot
    takes the last state of the slot before from a summary with one row per
    slot, which stays small. ``seq`` orders the snapshots of a load balancer.
    A task sorts one load balancer's slot, so its snapshots of an hour are the bound.
    """
    order = [F.asc(seq), F.asc("snapshot_id")]
    rows = snapshots.withColumn("__slot", F.date_trunc(slot, seq))
    in_slot = Window.partitionBy(*LB_KEYS, "__slot").orderBy(*order)
    marked = rows.withColumn("__prev", F.lag("state").over(in_slot)).withColumn(
        "__first", F.row_number().over(in_slot) == 1
    )
    ends = rows.groupBy(*LB_KEYS, "__slot").agg(
        F.max_by("state", F.struct(seq, "snapshot_id")).alias("__end")
    )
    across = Window.partitionBy(*LB_KEYS).orderBy("__slot")
    before = ends.select(*LB_KEYS, "__slot", F.lag("__end").over(across).alias("__before"))
    joined = marked.join(before, [*LB_KEYS, "__slot"], "left")
    prev = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__prev"))
    return joined.withColumn("from_state", prev).select(*snapshots.columns, "from_state")


def _before(rows: DataFrame, value: Column, order: list[str], slot: Column, keys: list[str]) -> DataFrame:
    """``value`` of the row before each within ``keys``, as ``__before``; a busy key is spread over its slots."""
    rows = rows.withColumn("__slot", slot).withColumn("__value", value)
    in_slot = Window.partitionBy(*keys, "__slot").orderBy(*order)
    rows = rows.withColumn("__prev", F.lag("__value").over(in_slot)).withColumn("__nth", F.row_number().over(in_slot))
    ends = rows.groupBy(*keys, "__slot").agg(F.max_by("__value", F.struct(*order)).alias("__end"))
    across = Window.partitionBy(*keys).orderBy("__slot")
    ends = ends.select(*keys, "__slot", F.lag("__end").over(across).alias("__earlier"))
    out = rows.join(ends, [*keys, "__slot"], "left")
    value = F.when(F.col("__nth") == 1, F.col("__earlier")).otherwise(F.col("__prev"))
    return out.withColumn("__before", value).drop("__slot", "__value", "__prev", "__nth", "__earlier")


def _next_stored(rows: DataFrame, slot: Column, keys: list[str]) -> DataFrame:
    """The first stored row after each, as ``__next`` (seen_at, snapshot_id, from_state); null after the last."""
    stored = F.when(~F.col("__fresh"), F.struct("seen_at", "snapshot_id", "from_state"))
    rows = rows.withColumn("__slot", slot).withColumn("__mark", stored)
    # backwards, so that a row sees those after it in one pass
    later = Window.partitionBy(*keys, "__slot").orderBy(F.desc("seen_at"), F.desc("snapshot_id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.min("__mark").over(later))
    firsts = rows.groupBy(*keys, "__slot").agg(F.min("__mark").alias("__first"))
    across = Window.partitionBy(*keys).orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(*keys, "__slot", F.min("__first").over(across).alias("__later"))
    out = rows.join(firsts, [*keys, "__slot"], "left")
    return out.withColumn("__next", F.coalesce("__in", "__later")).drop("__slot", "__mark", "__in", "__later")


def link_fresh(stored: DataFrame, fresh: DataFrame, last: DataFrame, slot: str = "hour") -> DataFrame:
    """Fresh snapshots with their ``from_state``, and the stored ones whose ``from_state`` they change.

    ``stored`` holds, for every fresh row, the stored row that follows it, and no
    more need be there: what a stored row came from is the state of the stored
    row before it, so that one is not read. After the last stored row that state
    is in ``last`` (one row for each load balancer). A row comes from the fresh
    row before it unless a stored row lies between the two, which is so when
    different stored rows follow them. The result has ``stored``'s columns and
    ``fresh``, a flag.
    """
    cols = stored.columns
    rows = stored.withColumn("__fresh", F.lit(False)).unionByName(
        fresh.withColumn("from_state", F.lit(None).cast("string")).select(*cols).withColumn("__fresh", F.lit(True))
    )
    part = F.date_trunc(slot, "seen_at")
    rows = _next_stored(rows, part, LB_KEYS)
    place = F.struct(F.col("__next.seen_at").alias("at"), F.col("__next.snapshot_id").alias("id"))
    # a stored row is what follows the fresh rows before it
    own = F.struct(F.col("seen_at").alias("at"), F.col("snapshot_id").alias("id"))
    mine = F.when(F.col("__fresh"), F.when(F.col("__next").isNotNull(), place)).otherwise(own)
    rows = rows.withColumn("__mine", mine)
    rows = _before(rows, F.struct("state", F.col("__fresh").alias("fresh"), F.col("__mine").alias("mine")), ["seen_at", "snapshot_id"], part, LB_KEYS)
    ends = last.select(*LB_KEYS, F.col("state").alias("__last"))
    rows = rows.join(ends, LB_KEYS, "left")
    by_fresh = F.coalesce(F.col("__before.fresh") & F.col("__before.mine").eqNullSafe(F.col("__mine")), F.lit(False))
    by_stored = F.when(~F.col("__fresh"), F.col("from_state")).when(F.col("__next").isNotNull(), F.col("__next.from_state")).otherwise(F.col("__last"))
    rows = rows.withColumn("__from", F.when(by_fresh, F.col("__before.state")).otherwise(by_stored))
    changed = F.col("__fresh") | ~F.col("__from").eqNullSafe(F.col("from_state"))
    return rows.filter(changed).select(*[F.col("__from").alias(c) if c == "from_state" else F.col(c) for c in cols], F.col("__fresh").alias("fresh"))


def changes(rows: DataFrame, seq: str = "seen_at") -> DataFrame:
    """The rows of ``with_previous`` at which the state changed."""
    return rows.filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("state"))).select(
        *LB_KEYS, "snapshot_id", "from_state", F.col("state").alias("to_state"), F.col(seq).alias("changed_at")
    )


def state_transitions(snapshots: DataFrame, seq: str = "seen_at", slot: str = "hour") -> DataFrame:
    """Rows whose state differs from the snapshot before, with the earlier state."""
    return changes(with_previous(snapshots, seq, slot), seq)


def last_states(snapshots: DataFrame, seq: str = "seen_at") -> DataFrame:
    """Newest snapshot of each load balancer."""
    row = F.max_by(F.struct("state", seq, "snapshot_id"), F.struct(seq, "snapshot_id"))
    return snapshots.groupBy(*LB_KEYS).agg(row.alias("r")).select(*LB_KEYS, "r.*")
