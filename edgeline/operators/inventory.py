"""Lists and counts over the current-state tables, for all tenants in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions import scalars as S
from edgeline.functions.timewin import AsOf, percent
from edgeline.operators.joins import POLICY_TYPES, unattached_policies

TENANT = ["tenant_id"]


def detail(table: DataFrame, **identity: str) -> DataFrame:
    """The row(s) of a current-state table with the given identity columns."""
    for column, value in identity.items():
        table = table.filter(F.col(column) == value)
    return table


# --- load balancers --------------------------------------------------------


def lb_list(load_balancers: DataFrame, namespace: str | None = None) -> DataFrame:
    rows = load_balancers
    if namespace:
        rows = rows.filter(F.col("namespace") == namespace)
    return rows.orderBy("tenant_id", "namespace", "name")


def lb_stats(load_balancers: DataFrame) -> DataFrame:
    return load_balancers.groupBy(*TENANT).agg(
        F.count("*").alias("total"),
        F.count_if("has_waf").alias("with_waf"),
        F.count_if("has_bot_defense").alias("with_bot_defense"),
        F.count_if("has_api_protection").alias("with_api_protection"),
        F.count_if("has_service_policy").alias("with_service_policy"),
        F.count_if(F.col("lb_type") == "https").alias("https"),
        F.count_if(F.col("lb_type") == "http").alias("http_only"),
    )


def coverage_pct(load_balancers: DataFrame) -> DataFrame:
    """Share of load balancers with each protection, in whole percent."""

    def pct(name: str) -> Column:
        return percent(F.col(name), F.col("total"), 0).cast("int")

    names = ["with_waf", "with_bot_defense", "with_api_protection", "with_service_policy"]
    return lb_stats(load_balancers).select(
        "tenant_id",
        "total",
        *[pct(n).alias(n.replace("with_", "pct_")) for n in names],
        pct("https").alias("pct_https"),
    )


# --- certificates ----------------------------------------------------------


def certificate_list(
    certificates: DataFrame,
    *,
    as_of: AsOf,
    warn_days: int = settings.CERT_WARN_DAYS,
    critical_days: int = settings.CERT_CRITICAL_DAYS,
) -> DataFrame:
    """Certificates with days left and status."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    days = S.days_until(F.col("not_after"), at)
    return certificates.withColumn("days_until_expiry", days).withColumn(
        "status", S.cert_status(F.col("days_until_expiry"), warn_days, critical_days)
    )


def certificates_by_expiry(
    certificates: DataFrame, *, as_of: AsOf, status: str | None = None, **limits: int
) -> DataFrame:
    """Soonest expiry first, unknown expiry last; optionally one status."""
    rows = certificate_list(certificates, as_of=as_of, **limits)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.asc_nulls_last("not_after"), "tenant_id", "namespace", "name")


def cert_stats(certificates: DataFrame, *, as_of: AsOf, **limits: int) -> DataFrame:
    """Certificates per status; unknown expiry counts in the total only."""
    rows = certificate_list(certificates, as_of=as_of, **limits)
    return rows.groupBy(*TENANT).agg(
        F.count("*").alias("total"),
        *[
            F.count_if(F.col("status") == s).alias(s)
            for s in ("ok", "warn", "critical", "expired")
        ],
    )


# --- origin pools and health -----------------------------------------------


def _cells(status: str) -> Column:
    return F.count_if(F.col("classified_status") == status)


def pool_health_rollup(
    pools: DataFrame, origin_health: DataFrame, touched: DataFrame | None = None, *, at: AsOf
) -> DataFrame:
    """Pools with their cell counts renewed; pools not touched in the cycle stay as they are."""
    when = at if isinstance(at, Column) else F.lit(at)
    key = ["tenant_id", "pool_id"]
    counts = origin_health.groupBy(*key).agg(
        _cells("healthy").alias("n_healthy"),
        _cells("unhealthy").alias("n_unhealthy"),
        _cells("warning").alias("n_warning"),
    )
    seen = (touched if touched is not None else origin_health).select(*key).distinct()
    j = pools.join(seen.withColumn("__hit", F.lit(True)), key, "left").join(counts, key, "left")
    hit = F.col("__hit").isNotNull()
    cols = {
        f"{s}_count": F.when(hit, F.coalesce(f"n_{s}", F.lit(0))).otherwise(F.col(f"{s}_count"))
        for s in ("healthy", "unhealthy", "warning")
    }
    cols["last_healthcheck_at"] = F.when(
        hit, when.cast(pools.schema["last_healthcheck_at"].dataType)
    ).otherwise(F.col("last_healthcheck_at"))
    return j.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in pools.columns])


def pool_stats(pools: DataFrame, origin_health: DataFrame) -> DataFrame:
    per_pool = pools.groupBy(*TENANT).agg(
        F.count("*").alias("total_pools"),
        F.count_if(F.col("unhealthy_count") > 0).alias("pools_with_unhealthy"),
        F.count_if(F.col("warning_count") > 0).alias("pools_with_warnings"),
        F.sum("origin_count").cast("bigint").alias("total_origins"),
    )
    per_cell = origin_health.groupBy(*TENANT).agg(
        _cells("unhealthy").alias("unhealthy_cells"), _cells("warning").alias("warning_cells")
    )
    return per_pool.join(per_cell, TENANT, "left").fillna(0, ["unhealthy_cells", "warning_cells"])


def pool_list(pools: DataFrame) -> DataFrame:
    return pools.orderBy("tenant_id", "namespace", "name")


def pool_detail(
    pools: DataFrame,
    origin_health: DataFrame,
    tenant_id: str | None = None,
    pool_id: str | None = None,
) -> DataFrame:
    """Health cells beside their pool and its sorted sites.

    With ``tenant_id`` and ``pool_id`` the cells of that pool alone, ordered by
    address and site; without, those of every pool, in no order.
    """
    key = ["tenant_id", "pool_id"]
    cells = origin_health
    for name, value in zip(key, (tenant_id, pool_id), strict=True):
        if value is not None:
            pools, cells = pools.filter(F.col(name) == value), cells.filter(F.col(name) == value)
    sites = cells.groupBy(*key).agg(F.array_sort(F.collect_set("site_name")).alias("sites"))
    p = pools.select(*key, "namespace", "name", "port", "lb_algorithm", "origin_count")
    out = p.join(cells, key).join(sites, key)
    return out.orderBy("origin_address", "site_name", "origin_port") if pool_id is not None else out


def health_by_origin(origin_health: DataFrame) -> DataFrame:
    """Cells per status of each origin address and port."""
    statuses = ["healthy", "unhealthy", "warning", "info", "unknown"]
    return origin_health.groupBy("tenant_id", "pool_id", "origin_address", "origin_port").agg(
        F.count("*").alias("total"), *[_cells(s).alias(s) for s in statuses]
    )


# --- policies --------------------------------------------------------------


def policy_stats(
    policies: DataFrame, attachments: DataFrame, tenants: DataFrame | None = None
) -> DataFrame:
    """Per policy type: total, shared, local and unattached."""
    key = ["tenant_id", "policy_type"]
    loose = unattached_policies(policies, attachments).groupBy(*key).agg(
        F.count("*").alias("unattached")
    )
    out = (
        policies.groupBy(*key)
        .agg(
            F.count("*").alias("total"),
            F.count_if("is_shared").alias("shared"),
            F.count_if(~F.col("is_shared")).alias("local"),
        )
        .join(loose, key, "left")
    )
    if tenants is not None:
        every = tenants.select(
            "tenant_id", F.explode(F.array(*[F.lit(t) for t in POLICY_TYPES])).alias("policy_type")
        ).distinct()
        out = every.join(out, key, "left")
    return out.fillna(0, ["total", "shared", "local", "unattached"])


def policy_list(policies: DataFrame, policy_type: str, scope: str | None = None) -> DataFrame:
    rows = policies.filter(F.col("policy_type") == policy_type)
    if scope:
        rows = rows.filter(F.col("is_shared") == F.lit(scope == "shared"))
    return rows.orderBy("tenant_id", "namespace", "name")


# --- audit -----------------------------------------------------------------


def audit_rows(raw: DataFrame) -> DataFrame:
    """Audit records with the caller's address resolved."""
    return raw.select(
        "id",
        "tenant_id",
        "actor_username",
        "event_type",
        "target",
        "result",
        S.client_ip_from_forwarded(F.col("forwarded_for"), F.col("peer")).alias("request_ip"),
        S.blank_to_null(F.col("user_agent")).alias("user_agent"),
        "created_at",
    )


def audit_tail(audit: DataFrame, n: int = settings.AUDIT_TAIL_ROWS) -> DataFrame:
    return audit.orderBy(F.desc("created_at"), F.asc("id")).limit(n)
