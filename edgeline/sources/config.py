"""Configuration objects -> load balancers, pools, sites, certificates, origin health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import jsontext as X
from edgeline.functions import jsonvals as J
from edgeline.functions import scalars as S
from edgeline.sources.landing import document


def spec_of(doc: Column) -> Column:
    """The object's settings, under either of the two names they arrive with."""
    return J.first_truthy(J.pick(doc, "$.get_spec"), J.pick(doc, "$.spec"))


def open_object(raw: DataFrame) -> DataFrame:
    """Parse a configuration object once: ``tenant_id, namespace, name, payload, doc, spec``."""
    parsed = raw.withColumn("doc", document(F.col("payload")))
    parsed = J.leaves(
        parsed,
        F.col("doc"),
        {
            "j_name": "$.name",
            "j_namespace": "$.namespace",
            "j_get": "$.get_spec",
            "j_spec": "$.spec",
        },
    )
    text = X.unwrapped(F.col("payload"))
    listed_in = F.col("namespace") if "namespace" in raw.columns else F.lit("")
    return parsed.select(
        "tenant_id",
        F.coalesce(J.first_text(F.col("j_namespace")), listed_in).alias("namespace"),
        F.coalesce(J.text(F.col("j_name")), F.lit("")).alias("name"),
        "payload",
        "doc",
        J.first_truthy(F.col("j_get"), F.col("j_spec")).alias("spec"),
        # the same object as text: VARIANT sorts keys, and the first one as written counts
        F.when(J.first_truthy(F.col("j_get")).isNotNull(), F.get_json_object(text, "$.get_spec"))
        .otherwise(F.get_json_object(text, "$.spec"))
        .alias("spec_text"),
    )


def _s(path: str) -> Column:
    return J.pick(F.col("spec"), f"$.{path}")


def _raw_spec() -> Column:
    return F.coalesce(F.to_json("spec"), F.lit("{}")).alias("raw_spec")


def watched_namespaces(tenants: DataFrame) -> DataFrame:
    """Namespaces each tenant watches: its list, or the single older setting."""
    many, one = F.col("namespaces"), F.array(F.col("namespace"))
    chosen = F.when(F.size(many) > 0, many).otherwise(one)
    return tenants.select("tenant_id", F.explode(chosen).alias("namespace"))


def only_watched(raw: DataFrame, watched: DataFrame) -> DataFrame:
    return raw.join(watched, ["tenant_id", "namespace"], "left_semi")


def lb_config(raw: DataFrame) -> DataFrame:
    """HTTP load balancers with type, exposure, protection flags and references."""
    df = open_object(raw)
    active = J.items(_s("active_service_policies.policies"))
    pools = F.filter(
        F.transform(J.items(_s("default_route_pools")), lambda p: J.pick(p, "$.pool")),
        lambda p: J.truthy(J.pick(p, "$.name")),
    )
    spec = F.col("spec")

    def any_of(*names: str) -> Column:
        return F.greatest(*[J.truthy(_s(n)) for n in names])

    return df.select(
        "tenant_id",
        "namespace",
        "name",
        F.transform(J.items(_s("domains")), J.text).alias("domains"),
        S.lb_type(spec).alias("lb_type"),
        S.advertise_mode(spec).alias("advertise_mode"),
        S.advertised_sites(spec).alias("advertised_sites"),
        J.truthy(_s("app_firewall")).alias("has_waf"),
        ((F.size(active) > 0) | J.not_null(_s("service_policies_from_namespace"))).alias(
            "has_service_policy"
        ),
        any_of("bot_defense", "bot_defense_advanced").alias("has_bot_defense"),
        any_of(
            "api_protection_rules", "api_discovery", "enable_api_discovery", "api_definition"
        ).alias("has_api_protection"),
        F.transform(pools, lambda p: J.text(J.pick(p, "$.name"))).alias("origin_pool_refs"),
        F.transform(pools, lambda p: J.text(J.pick(p, "$.namespace"))).alias(
            "origin_pool_ref_namespaces"
        ),
        J.text(_s("https.tls_cert_params.certificates[0].name")).alias("cert_ref"),
        _raw_spec(),
    )


def origin_pool_config(raw: DataFrame) -> DataFrame:
    servers = J.items(_s("origin_servers"))
    checks = F.filter(
        F.transform(J.items(_s("healthcheck")), lambda h: J.first_text(J.pick(h, "$.name"))),
        lambda n: n.isNotNull(),
    )
    return open_object(raw).select(
        "tenant_id",
        "namespace",
        "name",
        J.whole(_s("port")).cast("int").alias("port"),
        J.text(_s("loadbalancer_algorithm")).alias("lb_algorithm"),
        F.size(servers).alias("origin_count"),
        F.transform(servers, S.origin_address).alias("origin_addresses"),
        F.when(F.size(checks) > 0, checks).alias("healthcheck_refs"),
        _raw_spec(),
    )


def site_config(raw: DataFrame) -> DataFrame:
    """Sites; type from the settings, else recognised from the name."""
    return (
        open_object(raw)
        .filter(F.col("name") != "")
        .select(
            "tenant_id",
            "name",
            S.site_type(J.first_text(_s("site_type")), F.col("name")).alias("site_type"),
            J.text(J.pick(F.col("doc"), "$.system_metadata.operational_status")).alias(
                "operational_status"
            ),
            J.text(_s("region")).alias("region"),
            J.text(_s("provider")).alias("provider"),
            _raw_spec(),
        )
    )


def certificate_config(raw: DataFrame, decoded: DataFrame) -> DataFrame:
    """Certificate objects joined with their already decoded X.509 fields."""
    keys = ["tenant_id", "namespace", "name"]
    info = _s("auto_cert_info")
    objects = (
        open_object(raw)
        .filter(F.col("name") != "")
        .select(
            *keys,
            J.truthy(info).alias("auto_cert"),
            S.parse_iso(J.first_text(J.pick(info, "$.auto_cert_expiry"))).alias("auto_expiry"),
            J.first_text(J.pick(info, "$.auto_cert_subject_name")).alias("auto_subject"),
            _raw_spec(),
        )
    )
    return objects.join(decoded, keys, "left").select(
        *keys,
        F.coalesce("subject", "auto_subject").alias("subject"),
        "issuer",
        F.coalesce("san_dns", F.array().cast("array<string>")).alias("san_dns"),
        "not_before",
        F.coalesce("not_after", "auto_expiry").alias("not_after"),
        "serial_number",
        "fingerprint_sha256",
        "auto_cert",
        "raw_spec",
    )


def auto_certificates(load_balancers: DataFrame) -> DataFrame:
    """One certificate row per load balancer whose certificate is managed for it."""
    df = load_balancers.withColumn("spec", J.parse(F.col("raw_spec")))
    info = _s("auto_cert_info")
    rows = df.filter(J.truthy(_s("https_auto_cert"))).select(
        "tenant_id",
        "namespace",
        F.concat(F.col("name"), F.lit("-auto-cert")).alias("name"),
        J.text(J.pick(info, "$.auto_cert_subject")).alias("subject"),
        J.text(J.pick(info, "$.auto_cert_issuer")).alias("issuer"),
        F.col("domains").alias("san_dns"),
        F.lit(None).cast("timestamp").alias("not_before"),
        S.parse_iso(J.first_text(J.pick(info, "$.auto_cert_expiry"))).alias("not_after"),
        F.lit(None).cast("string").alias("serial_number"),
        F.lit(None).cast("string").alias("fingerprint_sha256"),
        F.lit(True).alias("auto_cert"),
        F.to_json(
            F.struct(
                F.col("name").alias("synthesized_from_lb"),
                F.coalesce(info, F.parse_json(F.lit("{}"))).alias("auto_cert_info"),
            )
        ).alias("raw_spec"),
    )
    return rows.filter(F.col("subject").isNotNull() | F.col("not_after").isNotNull())


def all_certificates(listed: DataFrame, load_balancers: DataFrame) -> DataFrame:
    """Listed certificates together with those managed for load balancers."""
    return listed.unionByName(auto_certificates(load_balancers))


def origin_health_from_raw(raw: DataFrame, sites: DataFrame) -> DataFrame:
    """Health cells: ``raw`` has ``tenant_id, pool_id, site_name, payload`` per origin."""
    from edgeline.operators.joins import health_site_type

    names = [
        "address",
        "port",
        "status",
        "consecutive_failures",
        "last_status_change",
        "last_probe",
    ]
    j = {n: F.col(f"j_{n}") for n in names}
    df = X.fixed(
        X.records(raw, names),
        {
            "raw_status": F.upper(F.coalesce(X.first_plain(j["status"]), F.lit("UNKNOWN"))),
            "changed": X.first_plain(j["last_status_change"]),
            "probed": X.first_plain(j["last_probe"]),
            **{n: j[n] for n in ("address", "port", "consecutive_failures")},
        },
        ["tenant_id", "pool_id", "site_name"],
    )
    cells = df.select(
        "tenant_id",
        "pool_id",
        F.coalesce(X.plain(F.col("address")), F.lit("")).alias("origin_address"),
        X.whole(F.col("port")).cast("int").alias("origin_port"),
        "site_name",
        "raw_status",
        S.origin_status(F.col("raw_status")).alias("classified_status"),
        F.coalesce(X.whole(F.col("consecutive_failures")), F.lit(0))
        .cast("int")
        .alias("consecutive_failures"),
        S.parse_iso(F.col("changed")).alias("last_status_change"),
        S.parse_iso(F.col("probed")).alias("last_probe_at"),
    )
    return health_site_type(cells, sites)
