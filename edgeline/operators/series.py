"""Overviews, five-minute series and top-k shared by the firewall and bot tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions.ranking import top_per_group
from edgeline.functions.timewin import AsOf, bucket, percent, round_half_up, within

TENANT = ["tenant_id"]
LB_KEYS = ["tenant_id", "lb_namespace", "lb_name"]


def lb_filter(events: DataFrame, load_balancers: DataFrame) -> DataFrame:
    """Events of the given load balancers, matched by (tenant, namespace, name)."""
    keys = load_balancers.select(
        "tenant_id", F.col("namespace").alias("lb_namespace"), F.col("name").alias("lb_name")
    )
    return events.join(keys, LB_KEYS, "left_semi")


def windowed(
    events: DataFrame, as_of: AsOf, lbs: DataFrame | None = None, *, upper: bool = True, **back: int
) -> DataFrame:
    rows = within(events, "event_time", as_of, timedelta(**back), upper=upper)
    return lb_filter(rows, lbs) if lbs is not None else rows


def per_tenant(rows: DataFrame, aggs: list[Column], tenants: DataFrame | None) -> DataFrame:
    """Aggregate per tenant; with ``tenants`` a tenant without rows gets zeros."""
    out = rows.groupBy(*TENANT).agg(*aggs)
    if tenants is not None:
        out = tenants.select(*TENANT).distinct().join(out, TENANT, "left").fillna(0)
    return out


def action_counts(names: dict[str, str]) -> list[Column]:
    return [F.count_if(F.col("action") == a).alias(n) for a, n in names.items()]


def sparkline(
    events: DataFrame, names: dict[str, str], *, by: list[str] | None = None
) -> DataFrame:
    """Counters per five-minute bucket; empty buckets are absent."""
    keys = by or TENANT
    return events.groupBy(*keys, bucket("event_time").alias("bucket_time")).agg(
        F.count("*").alias("request_count"), *action_counts(names)
    )


def sparkline_totals(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals of a sparkline, summed over its points."""
    keys = keys or TENANT
    counters = [c for c in points.columns if c.endswith("_count")]
    return points.groupBy(*keys).agg(
        F.count("*").alias("points"), *[F.sum(c).alias(f"total_{c}") for c in counters]
    )


def count_topk(
    events: DataFrame, dim: str, k: int, *, where: Column | None = None
) -> DataFrame:
    """Most frequent values of one column per tenant; smallest key first on a tie."""
    rows = events.filter(F.col(dim).isNotNull())
    if where is not None:
        rows = rows.filter(where)
    counts = (
        rows.groupBy(*TENANT, dim)
        .agg(F.count("*").alias("count"))
        .select(*TENANT, F.col(dim).cast("string").alias("key"), "count")
    )
    return top_per_group(counts, TENANT, [F.desc("count"), F.asc("key")], k)


def share_of_max(topk: DataFrame) -> DataFrame:
    """Whole percent of each tenant's largest entry."""
    top = F.max("count").over(Window.partitionBy(*TENANT))
    share = round_half_up(F.col("count") / top * 100.0, 0).cast("int")
    return topk.withColumn("pct_of_max", F.when(top > 0, share).otherwise(F.lit(0)))


def donut(topk: DataFrame, slices: int = settings.DONUT_SLICES) -> DataFrame:
    """The first slices of a top-k with the total over all its entries."""
    all_rows = Window.partitionBy(*TENANT)
    with_total = topk.withColumn("total", F.sum("count").over(all_rows))
    return top_per_group(with_total, TENANT, [F.desc("count"), F.asc("key")], slices)


def rate(part: str, total: str, digits: int = 2) -> Column:
    return percent(F.col(part), F.col(total), digits)


def metric_totals_per_sync(df: DataFrame, by: str) -> DataFrame:
    """Rows per state / rule / signal, reported by a job for monitoring."""
    return df.groupBy(by).agg(F.count("*").alias("rows"))


def observe_totals(df: DataFrame, name: str, conditions: dict[str, Column]) -> DataFrame:
    """The same totals collected while the job runs, without another pass."""
    return df.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c).alias(n) for n, c in conditions.items()],
    )


def distinct_values(columns: list[str], *tables: DataFrame) -> DataFrame:
    """Distinct rows of the given columns over several tables.

    Each table is made distinct by itself first, so the union moves only
    distinct rows.
    """
    out = tables[0].select(*columns).distinct()
    for other in tables[1:]:
        out = out.unionByName(other.select(*columns).distinct())
    return out.distinct() if len(tables) > 1 else out


def distinct_counts(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Exact distinct non-null values per tenant of several columns.

    Rows become (column, value) pairs that are made distinct before they are
    counted: one hot tenant is spread over its values.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
            for n, c in names.items()
        ]
    )
    values = rows.select(*TENANT, F.inline(pairs)).distinct()
    counted = values.groupBy(*TENANT)
    present = F.col("value").isNotNull()
    return counted.agg(*[F.count_if(present & (F.col("name") == n)).alias(n) for n in names])
