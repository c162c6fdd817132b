"""Look-ups between current-state tables, as distributed joins.

No join is hinted to broadcast: these tables grow with the number of tenants,
so AQE decides from the measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeline.functions import scalars as S
from edgeline.functions.jsonvals import strip

LB_KEYS = ["tenant_id", "lb_namespace", "lb_name"]
POLICY_REF = ["tenant_id", "policy_type", "policy_namespace", "policy_name"]
POLICY_TYPES = ["app_firewall", "service_policy", "bot_defense_policy", "api_definition"]
# copies of the RE site list a hot tenant's pools are spread over
SITE_SALTS = 16
# in this order health rows are sorted and joined: the few tenants tell few rows apart
POOL = ["pool_id", "tenant_id"]
ORIGIN = ["pool_id", "origin_address", "origin_port", "tenant_id"]


def all_policies(by_type: dict[str, DataFrame]) -> DataFrame:
    """The policy tables as one frame ``tenant_id, policy_type, namespace, name, is_shared``."""
    out = None
    for kind, df in by_type.items():
        part = df.select(
            "tenant_id", F.lit(kind).alias("policy_type"), "namespace", "name", "is_shared"
        )
        out = part if out is None else out.unionByName(part)
    return out


def lb_pools(
    load_balancers: DataFrame, pools: DataFrame, *, match_namespace: bool = False
) -> DataFrame:
    """Pools of each load balancer, by pool name within the tenant.

    The stored references carry no namespace requirement, so a name matches in
    any namespace unless ``match_namespace`` is set.
    """
    refs = load_balancers.select(
        "tenant_id",
        F.col("namespace").alias("lb_namespace"),
        F.col("name").alias("lb_name"),
        F.explode(
            F.array_distinct(F.arrays_zip("origin_pool_refs", "origin_pool_ref_namespaces"))
            if match_namespace
            else F.transform(
                F.array_distinct("origin_pool_refs"), lambda r: F.struct(r.alias("origin_pool_refs"))
            )
        ).alias("ref"),
    )
    refs = refs.withColumn("pool_name", F.col("ref.origin_pool_refs"))
    on = ["tenant_id", "pool_name"]
    p = pools.withColumnsRenamed({"namespace": "pool_namespace", "name": "pool_name"})
    if match_namespace:
        refs = refs.withColumn("pool_namespace", F.col("ref.origin_pool_ref_namespaces"))
        on = [*on, "pool_namespace"]
    return refs.drop("ref").join(p, on)


def _definition_links(attachments: DataFrame) -> DataFrame:
    return attachments.filter(F.col("policy_type") == "api_definition").select(
        *LB_KEYS,
        F.col("policy_namespace").alias("namespace"),
        F.col("policy_name").alias("name"),
    )


def _declared_pairs(api_definitions: DataFrame) -> DataFrame:
    return api_definitions.select(
        "tenant_id", "namespace", "name", F.inline("declared_endpoints")
    ).select(
        "tenant_id",
        "namespace",
        "name",
        strip(F.upper("method")).alias("method"),
        strip(F.col("path")).alias("endpoint_path"),
    )


def declared_endpoints(attachments: DataFrame, api_definitions: DataFrame) -> DataFrame:
    """(load balancer, method, path) triples declared by attached API definitions."""
    pairs = _declared_pairs(api_definitions)
    return (
        _definition_links(attachments)
        .join(pairs, ["tenant_id", "namespace", "name"])
        .select(*LB_KEYS, "method", "endpoint_path")
        .distinct()
    )


def shadow_detection(
    endpoints: DataFrame, attachments: DataFrame, api_definitions: DataFrame
) -> DataFrame:
    """Endpoints with ``is_shadow``: not declared for their load balancer.

    Only exact paths match; a template such as ``/users/{id}`` covers no
    concrete path. Each endpoint is looked up in the few definitions its load
    balancer has, so a definition shared by very many load balancers is never
    expanded into one row per load balancer and path.
    """
    keys = [*LB_KEYS, "method", "endpoint_path"]
    linked = endpoints.select(*keys).join(_definition_links(attachments).distinct(), LB_KEYS)
    found = linked.join(
        _declared_pairs(api_definitions),
        ["tenant_id", "namespace", "name", "method", "endpoint_path"],
        "left_semi",
    )
    known = found.select(*keys).distinct().withColumn("__declared", F.lit(True))
    return (
        endpoints.join(known, keys, "left")
        .withColumn("is_shadow", F.col("__declared").isNull())
        .drop("__declared")
    )


def lb_policies(attachments: DataFrame, policies: DataFrame) -> DataFrame:
    """Attachments resolved to policies; unresolved ones keep a null policy_id."""
    known = policies.select(
        "tenant_id",
        "policy_type",
        F.col("namespace").alias("policy_namespace"),
        F.col("name").alias("policy_name"),
        F.concat_ws("/", "policy_type", "namespace", "name").alias("policy_id"),
        F.col("is_shared").alias("__shared"),
    )
    return (
        attachments.join(known, POLICY_REF, "left")
        .withColumn(
            "is_shared", F.coalesce("__shared", S.is_shared(F.col("policy_namespace")))
        )
        .drop("__shared")
    )


def unattached_policies(policies: DataFrame, attachments: DataFrame) -> DataFrame:
    """Policies no load balancer of the tenant refers to."""
    used = attachments.select(
        "tenant_id",
        "policy_type",
        F.col("policy_namespace").alias("namespace"),
        F.col("policy_name").alias("name"),
    )
    return policies.join(used, ["tenant_id", "policy_type", "namespace", "name"], "left_anti")


def policy_attached_to(
    policies: DataFrame, attachments: DataFrame, load_balancers: DataFrame
) -> DataFrame:
    """Reverse look-up: one row per policy and load balancer that refers to it."""
    lbs = load_balancers.select(
        "tenant_id", F.col("namespace").alias("lb_namespace"), F.col("name").alias("lb_name")
    )
    p = policies.select(
        "tenant_id",
        "policy_type",
        F.col("namespace").alias("policy_namespace"),
        F.col("name").alias("policy_name"),
        "is_shared",
    )
    return p.join(attachments, POLICY_REF).join(lbs, LB_KEYS, "left_semi")


def probe_targets(load_balancers: DataFrame, sites: DataFrame, pools: DataFrame) -> DataFrame:
    """Distinct (pool, site) pairs to probe.

    The marker for all RE sites is expanded per pool, after duplicates from many
    load balancers are gone. The RE list is repeated over a few salts so a
    tenant with very many pools is spread over tasks.
    """
    refs = load_balancers.select(
        "tenant_id", F.explode("origin_pool_refs").alias("pool_name"), "advertised_sites"
    ).select("tenant_id", "pool_name", F.explode("advertised_sites").alias("ref"))
    refs = refs.distinct().join(
        pools.select("tenant_id", F.col("name").alias("pool_name")).distinct(),
        ["tenant_id", "pool_name"],
        "left_semi",
    )
    virtual = F.col("ref").startswith(S.VIRTUAL_PREFIX)
    bare = F.substr(F.col("ref"), F.lit(len(S.VIRTUAL_PREFIX) + 1))
    everywhere = F.col("ref") == S.ALL_RE_SITES
    # named sites get negative salts: they match no RE site and stay spread
    spread = F.xxhash64("pool_name", "ref")
    salt = F.when(everywhere, F.pmod(spread, F.lit(SITE_SALTS))).otherwise(
        F.lit(-1) - F.pmod(spread, F.lit(1024))
    )
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SITE_SALTS - 1).cast("bigint"))
    re_sites = sites.filter(F.col("site_type") == "re").select(
        "tenant_id", F.col("name").alias("re_site"), F.explode(salts).alias("salt")
    )
    site = F.when(everywhere, F.col("re_site")).when(virtual, bare).otherwise(F.col("ref"))
    return (
        refs.withColumn("salt", salt)
        .join(re_sites, ["tenant_id", "salt"], "left")
        .select("tenant_id", "pool_name", site.alias("site_name"))
        .filter(F.col("site_name").isNotNull())
        .distinct()
    )


def health_site_type(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """Health cells tagged with the type of their site; null when it is unknown."""
    kinds = sites.select("tenant_id", F.col("name").alias("site_name"), "site_type")
    return cells.drop("site_type").join(kinds, ["tenant_id", "site_name"], "left")


def health_matrix(origin_health: DataFrame) -> DataFrame:
    """Probed cells of every pool, each with the number of the pool's sites its origin has no probe from.

    One shape for pools of any size: no grid is built. Cells are gathered per
    origin (as many as the pool has sites), which meets its pool's site count in
    one join.
    """
    key = ["tenant_id", "pool_id"]
    origin = [*key, "origin_address", "origin_port"]
    cell = F.struct("site_name", F.col("classified_status").alias("status"), "consecutive_failures")
    origins = origin_health.groupBy(*origin).agg(
        F.collect_list(cell).alias("cells"), F.count_distinct("site_name").alias("probed")
    )
    sites = origin_health.groupBy(*key).agg(F.count_distinct("site_name").alias("sites"))
    return origins.join(sites, key).select(
        *origin, (F.col("sites") - F.col("probed")).alias("sites_without_probe"), F.inline("cells")
    )


NO_PROBE = "no probe"


def _pool_sites(probed: DataFrame) -> DataFrame:
    """The sites of each pool as one sorted array."""
    return probed.groupBy(*POOL).agg(F.array_sort(F.collect_set("site_name")).alias("sites"))


def _origins(probed: DataFrame, **found: Column) -> DataFrame:
    """One row per origin with aggregates of its cells.

    A window over sorted cells: with nearly as many origins as cells, object
    aggregates would be built, written and sorted once more for each.
    """
    cells = Window.partitionBy(*ORIGIN).orderBy("site_name")
    every = cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.lead("site_name").over(cells).isNull().alias("last")
    rows = probed.select(*ORIGIN, last, *[agg.over(every).alias(name) for name, agg in found.items()])
    return rows.where("last").drop("last")


def health_grid(origin_health: DataFrame) -> DataFrame:
    """Every origin of a pool with every site of the pool; a cell without a probe says ``no probe``.

    The sites of a pool are one sorted array, as long as the pool has sites. An
    origin's cells meet it in one join and the names of the sites they lack
    follow theirs, so no pairs are built beyond the grid itself and the null port
    of an origin stays a value. The cells of one pool are grouped by origin, and
    nothing is gathered by pool after the join, so AQE may split a pool with
    very many origins. Cells without a site are not part of a grid.
    """
    probed = origin_health.filter(F.col("site_name").isNotNull())
    cell = F.struct("site_name", F.col("classified_status").alias("status"), "consecutive_failures")
    origins = _origins(probed, cells=F.collect_list(cell))
    seen = F.col("cells.site_name")
    names = F.concat(seen, F.array_except("sites", seen))
    grid = origins.join(_pool_sites(probed), POOL).select("*", F.posexplode(names).alias("at", "site_name"))
    there, now = F.col("at") < F.size("cells"), F.get("cells", F.col("at"))
    return grid.select(
        "tenant_id",
        "pool_id",
        "origin_address",
        "origin_port",
        "site_name",
        F.when(there, now["status"]).otherwise(NO_PROBE).alias("status"),
        F.when(there, now["consecutive_failures"]).alias("consecutive_failures"),
    )


def health_grid_by_origin(origin_health: DataFrame) -> DataFrame:
    """The grid with one row per origin: cells per status, sites without a probe, and their names in order.

    For callers that show large pools grouped; it holds what ``health_grid`` does
    and builds no cell for a missing probe.
    """
    probed = origin_health.filter(F.col("site_name").isNotNull())
    origins = _origins(
        probed,
        healthy=F.count_if(F.col("classified_status") == "healthy"),
        probes=F.count("*"),
        seen=F.collect_set("site_name"),
    )
    blind = F.array_except("sites", "seen")
    return origins.join(_pool_sites(probed), POOL).select(
        "tenant_id", "pool_id", "origin_address", "origin_port",
        "healthy", "probes", F.size(blind).cast("long").alias("no_probe"), blind.alias("blind_sites"),
    )


def new_vs_prior(recent: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    """Recent rows whose key does not occur before; recent rows keep their columns."""
    return recent.join(prior.select(*key), key, "left_anti")
