"""Policy objects and the links between policies and load balancers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import jsonvals as J
from edgeline.functions import scalars as S
from edgeline.sources.config import _raw_spec, _s, open_object

# Fixed values.
HTTP_VERBS = ["delete", "get", "head", "options", "patch", "post", "put", "trace"]
DEFAULT_ACTIONS = {
    "allow_list": "ALLOW",
    "default_action_next_policy": "NEXT_POLICY",
    "deny_list": "DENY",
    "legacy_default_action_next_policy": "NEXT_POLICY",
}
DETECTION_KEYS = [
    "default_detection_settings",
    "default_violation_settings",
    "detection_settings",
]
GEO_KEYS = ["country_list", "asn_list", "geo_list"]
IP_KEYS = ["ip_prefix_list", "ip_matcher", "client_selector_ip"]
PATH_KEYS = ["path", "path_match", "url_matcher"]


def system_policy_filter(raw: DataFrame, prefix: str) -> DataFrame:
    """Leave out unnamed policies and those a platform generates under a name prefix."""
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    return raw.filter(named & ~F.col("name").startswith(prefix))


def _base() -> list[Column]:
    return [
        F.col("tenant_id"),
        F.col("namespace"),
        F.col("name"),
        S.is_shared(F.col("namespace")).alias("is_shared"),
    ]


def _choice(field: str) -> Column:
    """First key of an object setting, or the setting itself when it is text."""
    v = _s(field)
    first = J.first_key(F.col("spec_text"), f"$.{field}")
    return F.when(J.is_object(v), first).when(J.is_string(v), J.text(v))


def _has_any(v: Column, names: list[str]) -> Column:
    return F.greatest(*[J.present(J.key(v, n)) for n in names])


def app_firewall_config(raw: DataFrame) -> DataFrame:
    labels = F.array_compact(
        F.array(
            F.when(J.present(_s("blocking_settings")), "blocking"),
            F.when(
                J.present(_s("default_attack_categories_action")), "default_attack_categories"
            ),
        )
    )
    categories = F.concat(F.map_keys(J.fields(_s("violation_settings"))), labels)
    blocked = F.map_keys(
        F.map_filter(
            J.fields(_s("blocking_settings")),
            lambda _, v: F.coalesce(
                F.when(J.is_object(v), J.text(J.pick(v, "$.action")))
                .when(J.is_string(v), J.text(v))
                .isin("BLOCK", "BLOCKING"),
                F.lit(False),
            ),
        )
    )
    custom = J.first_truthy(_s("custom_anonymization"), _s("custom_violation_actions"))
    wrapped = J.first_truthy(J.pick(custom, "$.rules"), J.pick(custom, "$.custom_rules"))
    excluded = J.pick(_s("violation_settings_choice"), "$.exclusions")
    codes = _s("allowed_response_codes")
    inner = J.first_truthy(J.pick(codes, "$.response_code"), J.pick(codes, "$.response_codes"))

    def ints(v: Column) -> Column:
        return F.transform(F.filter(J.items(v), J.is_integer), lambda c: c.try_cast("int"))

    return open_object(raw).select(
        *_base(),
        F.when(J.present(_s("blocking")), "blocking")
        .when(J.present(_s("monitoring")), "monitoring")
        .alias("enforcement_mode"),
        _choice("default_anonymization").alias("default_anonymization"),
        _choice("default_bot_setting").alias("default_bot_setting"),
        F.coalesce(*[F.when(J.present(_s(k)), F.lit(k)) for k in DETECTION_KEYS]).alias(
            "detection_settings"
        ),
        F.array_sort(F.array_distinct(categories)).alias("enabled_signature_categories"),
        F.array_sort(F.array_distinct(blocked)).alias("blocked_attack_types"),
        F.when(J.is_object(custom), F.size(J.items(wrapped)))
        .otherwise(F.size(J.items(custom)))
        .alias("custom_rule_count"),
        F.when(J.is_array(_s("exclusion_rules")), F.size(J.items(_s("exclusion_rules"))))
        .otherwise(F.size(J.items(excluded)))
        .alias("exclusion_rule_count"),
        F.when(J.is_object(codes) & (inner.isNull() | J.is_array(inner)), ints(inner))
        .when(J.is_array(codes), ints(codes))
        .alias("allowed_response_codes"),
        _raw_spec(),
    )


def service_policy_config(raw: DataFrame) -> DataFrame:
    rules = J.items(_s("rules"))
    bodies = F.filter(
        F.transform(
            F.filter(rules, J.is_object),
            lambda r: F.coalesce(
                J.first_truthy(J.pick(r, "$.simple_rule"), J.pick(r, "$.custom_rule")), r
            ),
        ),
        J.is_object,
    )

    def with_action(*names: str) -> Column:
        return F.size(
            F.filter(
                bodies,
                lambda b: J.is_string(J.pick(b, "$.action"))
                & F.upper(J.text(J.pick(b, "$.action"))).isin(*names),
            )
        )

    first = J.first_key(F.col("spec_text"), "$.default_action_choice")
    return open_object(raw).select(
        *_base(),
        F.coalesce(S.lookup(first, DEFAULT_ACTIONS), F.upper(first)).alias("default_action"),
        F.size(rules).alias("rule_count"),
        with_action("ALLOW", "ALLOW_LIST").alias("allow_rule_count"),
        with_action("DENY", "DENY_LIST").alias("deny_rule_count"),
        F.exists(bodies, lambda b: _has_any(b, GEO_KEYS)).alias("has_geo_rules"),
        F.exists(bodies, lambda b: _has_any(b, IP_KEYS)).alias("has_ip_rules"),
        F.exists(bodies, lambda b: _has_any(b, PATH_KEYS)).alias("has_path_rules"),
        _raw_spec(),
    )


def bot_policy_config(raw: DataFrame) -> DataFrame:
    endpoints = J.items(_s("protected_app_endpoints"))
    objects = F.filter(endpoints, J.is_object)
    paths = F.flatten(
        F.transform(
            objects,
            lambda e: F.transform(
                F.filter(F.map_values(J.fields(J.pick(e, "$.path"))), J.is_string), J.text
            ),
        )
    )
    actions = F.transform(
        objects, lambda e: J.first_truthy(J.pick(e, "$.mitigation"), J.pick(e, "$.flow_label"))
    )

    def mitigated_by(name: str) -> Column:
        return F.exists(actions, lambda m: J.present(J.key(m, name)))

    return open_object(raw).select(
        *_base(),
        F.size(endpoints).alias("protected_endpoint_count"),
        F.array_sort(F.array_distinct(paths)).alias("protected_paths"),
        mitigated_by("js_challenge").alias("has_javascript_challenge"),
        mitigated_by("captcha_challenge").alias("has_captcha_challenge"),
        mitigated_by("redirect").alias("has_redirect"),
        mitigated_by("block").alias("has_block"),
        _raw_spec(),
    )


def api_definition_config(raw: DataFrame) -> DataFrame:
    """API definitions with the (method, path) pairs they declare; null when none."""
    specs = J.items(_s("api_specs"))
    objects = F.filter(specs, J.is_object)

    def documents(name: str) -> Column:
        return F.filter(F.transform(objects, lambda s: J.key(s, name)), J.is_object)

    swagger, openapi = documents("swagger_spec"), documents("openapi_spec")
    paths = F.transform(
        F.concat(swagger, openapi), lambda d: F.map_entries(J.fields(J.pick(d, "$.paths")))
    )
    declared = F.flatten(
        F.transform(
            F.flatten(paths),
            lambda p: F.transform(
                F.filter(
                    F.map_keys(J.fields(p["value"])), lambda m: F.lower(m).isin(HTTP_VERBS)
                ),
                lambda m: F.struct(F.upper(m).alias("method"), p["key"].alias("path")),
            ),
        )
    )
    first_kind = F.filter(
        F.transform(
            objects,
            lambda s: F.when(J.is_object(J.key(s, "swagger_spec")), "swagger").when(
                J.is_object(J.key(s, "openapi_spec")), "openapi"
            ),
        ),
        lambda f: f.isNotNull(),
    )
    checked = F.exists(
        objects,
        lambda s: J.truthy(J.key(s, "validation")) | J.truthy(J.key(s, "validation_rules")),
    )
    return (
        open_object(raw)
        .select(
            *_base(),
            F.get(first_kind, F.lit(0)).alias("spec_format"),
            F.size(specs).alias("api_specs_count"),
            F.size(F.flatten(paths)).alias("endpoint_count"),
            (
                checked
                | J.truthy(_s("validation_rules"))
                | J.truthy(_s("api_validation_rules"))
            ).alias("has_validation_rules"),
            declared.alias("declared"),
            _raw_spec(),
        )
        .withColumn("declared_endpoints", F.when(F.size("declared") > 0, F.col("declared")))
        .drop("declared")
    )


def _bot_block(spec: Column) -> Column:
    bot = J.first_truthy(J.key(spec, "bot_defense"), J.key(spec, "bot_defense_advanced"))
    return F.when(J.is_object(bot), bot)


def _named_endpoints(spec: Column) -> Column:
    """Inline protected endpoints that carry a name."""
    return F.filter(
        J.items(J.pick(_bot_block(spec), "$.policy.protected_app_endpoints")),
        lambda e: J.truthy(J.pick(e, "$.metadata.name")),
    )


def inline_bot_policies(load_balancers: DataFrame) -> DataFrame:
    """One bot policy per named inline endpoint, in its load balancer's namespace."""
    rows = load_balancers.withColumn("spec", J.parse(F.col("raw_spec"))).select(
        "tenant_id",
        "namespace",
        F.col("name").alias("lb_name"),
        F.explode(_named_endpoints(F.col("spec"))).alias("ep"),
    )
    mitigation = J.pick(F.col("ep"), "$.mitigation")
    paths = [J.first_text(J.pick(F.col("ep"), f"$.path.{k}")) for k in ("prefix", "exact", "regex")]

    def uses(name: str) -> Column:
        return J.present(J.key(mitigation, name))

    return rows.select(
        "tenant_id",
        "namespace",
        J.text(J.pick(F.col("ep"), "$.metadata.name")).alias("name"),
        F.lit(False).alias("is_shared"),
        F.lit(1).alias("protected_endpoint_count"),
        F.array_compact(F.array(*paths)).alias("protected_paths"),
        uses("javascript_challenge").alias("has_javascript_challenge"),
        uses("captcha_challenge").alias("has_captcha_challenge"),
        uses("redirect").alias("has_redirect"),
        uses("block").alias("has_block"),
        F.to_json(
            F.struct(
                F.lit("bot_defense.policy.protected_app_endpoints").alias("synthesized_from"),
                F.col("lb_name"),
                F.col("ep").alias("endpoint"),
            )
        ).alias("raw_spec"),
        "lb_name",
    )


def all_bot_policies(listed: DataFrame, load_balancers: DataFrame) -> DataFrame:
    """Listed bot policies together with those written inline on load balancers.

    Two load balancers may use one endpoint name in a namespace; the key keeps
    the one of the load balancer that sorts last.
    """
    from edgeline.operators.merge import OBJECT_KEYS, one_per_key

    inline = one_per_key(
        inline_bot_policies(load_balancers), OBJECT_KEYS, F.col("lb_name"), newest=True
    )
    return listed.unionByName(inline.drop("lb_name"))


def policy_attachments_from_lbs(load_balancers: DataFrame) -> DataFrame:
    """Every policy a load balancer refers to, once each.

    The references of one load balancer sit in its own row, so duplicates are
    removed inside the row and no shuffle is needed.
    """
    df = load_balancers.withColumn("spec", J.parse(F.col("raw_spec")))

    def refs(kind: str, found: Column) -> Column:
        named = F.filter(found, lambda r: J.is_object(r) & J.truthy(J.pick(r, "$.name")))
        return F.transform(
            named,
            lambda r: F.struct(
                F.lit(kind).alias("policy_type"),
                F.coalesce(J.first_text(J.pick(r, "$.namespace")), F.lit("")).alias(
                    "policy_namespace"
                ),
                J.text(J.pick(r, "$.name")).alias("policy_name"),
            ),
        )

    bot_ref = J.pick(_bot_block(F.col("spec")), "$.ref")
    inline = F.transform(
        _named_endpoints(F.col("spec")),
        lambda e: F.struct(
            F.lit("bot_defense_policy").alias("policy_type"),
            F.col("namespace").alias("policy_namespace"),
            J.text(J.pick(e, "$.metadata.name")).alias("policy_name"),
        ),
    )
    has_ref = J.is_object(bot_ref) & J.truthy(J.pick(bot_ref, "$.name"))
    definition = _s("api_definition")
    every = F.concat(
        refs("app_firewall", F.array(_s("app_firewall"))),
        refs("service_policy", J.items(_s("active_service_policies.policies"))),
        F.when(has_ref, refs("bot_defense_policy", F.array(bot_ref))).otherwise(inline),
        *[
            refs("api_definition", J.items(J.pick(definition, f"$.{k}")))
            for k in ("api_definitions", "api_definition_ref")
        ],
        refs("api_definition", F.array(definition)),
    )
    return df.select(
        "tenant_id",
        F.col("namespace").alias("lb_namespace"),
        F.col("name").alias("lb_name"),
        F.inline(F.array_distinct(every)),
    )
