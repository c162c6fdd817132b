"""API discovery records: endpoint inventory and per load balancer learning state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import jsontext as X
from edgeline.functions import scalars as S
from edgeline.functions.jsonvals import strip

KEYS = ["tenant_id", "lb_namespace", "lb_name"]


def _j(name: str) -> Column:
    return F.col(f"j_{name}")


def _first(*names: str) -> Column:
    return X.first(*[_j(n) for n in names])


def _plain(*names: str) -> Column:
    return X.plain(_first(*names))


def api_endpoints_from_raw(raw: DataFrame) -> DataFrame:
    """Discovered endpoints; records without a method or a path are dropped."""
    names = [
        "method",
        "http_method",
        "path",
        "endpoint",
        "url",
        "api_definition",
        "discovery_confidence",
        "confidence",
        "total_request_samples",
        "sample_count",
        "response_codes",
        "observed_response_codes",
        "last_seen",
        "last_seen_at",
        "first_seen",
        "first_seen_at",
        "query_params",
        "body_params",
        "auth_type",
        "authentication",
    ]
    definition = F.when(X.is_object(_j("api_definition")), _j("api_definition"))
    chosen = X.fixed(
        X.records(raw, names, decimals=True),
        {
            "method": strip(F.upper(_plain("method", "http_method"))),
            "endpoint_path": S.blank_to_null(strip(_plain("path", "endpoint", "url"))),
            "definition": F.from_json(definition, X.struct_of(["namespace", "name"])),
            "confidence": X.either(_j("discovery_confidence"), _j("confidence")),
            "samples": _first("total_request_samples", "sample_count"),
            "codes": X.elements(_first("response_codes", "observed_response_codes")),
            "last": _plain("last_seen", "last_seen_at"),
            "first": _plain("first_seen", "first_seen_at"),
            "query_params": F.when(X.is_array(_j("query_params")), X.plain_json(_j("query_params"))),
            "body_params": F.when(X.is_array(_j("body_params")), X.plain_json(_j("body_params"))),
            "auth": _plain("auth_type", "authentication"),
        },
        KEYS,
    )
    listed = F.transform(F.array_compact("codes"), X.whole)
    usable = ~F.exists(listed, lambda c: c.isNull())
    return chosen.filter((F.col("method") != "") & F.col("endpoint_path").isNotNull()).select(
        *KEYS,
        "method",
        "endpoint_path",
        X.plain(F.col("definition.namespace")).alias("api_definition_namespace"),
        X.plain(F.col("definition.name")).alias("api_definition_name"),
        X.score(F.col("confidence")).cast("int").alias("discovery_confidence"),
        F.coalesce(X.whole(F.col("samples")), F.lit(0)).alias("total_request_samples"),
        S.parse_iso(F.col("last")).alias("last_seen_at"),
        S.parse_iso(F.col("first")).alias("first_seen_at"),
        F.when(usable, F.transform(listed, lambda c: c.cast("int"))).alias("response_codes"),
        "query_params",
        "body_params",
        S.auth_type(F.col("auth")).alias("auth_type"),
    )


def api_endpoint_inventory(
    raw: DataFrame, attachments: DataFrame, api_definitions: DataFrame
) -> DataFrame:
    """Discovered endpoints with their shadow flag.

    The API definition is reported only for declared endpoints.
    """
    from edgeline.operators.joins import shadow_detection

    out = shadow_detection(api_endpoints_from_raw(raw), attachments, api_definitions)
    for c in ("api_definition_namespace", "api_definition_name"):
        out = out.withColumn(c, F.when(~F.col("is_shadow"), F.col(c)))
    return out


def api_discovery_state(raw: DataFrame) -> DataFrame:
    """One learning-state row per load balancer document."""
    names = [
        "state",
        "confidence_score",
        "confidence",
        "total_endpoints_discovered",
        "endpoint_count",
        "total_traffic_samples",
        "sample_count",
        "last_learning_update",
        "last_update",
        "state_changed_at",
        "state_transition_at",
    ]
    df = X.fixed(
        X.records(raw, names, decimals=True),
        {
            "raw_state": _plain("state"),
            "score": X.either(_j("confidence_score"), _j("confidence")),
            "endpoints": _first("total_endpoints_discovered", "endpoint_count"),
            "samples": _first("total_traffic_samples", "sample_count"),
            "updated": _plain("last_learning_update", "last_update"),
            "changed": _plain("state_changed_at", "state_transition_at"),
        },
        KEYS,
    )
    return df.select(
        *KEYS,
        S.discovery_state(F.col("raw_state")).alias("state"),
        X.score(F.col("score")).cast("int").alias("confidence_score"),
        F.coalesce(X.whole(F.col("endpoints")), F.lit(0)).alias("total_endpoints_discovered"),
        F.coalesce(X.whole(F.col("samples")), F.lit(0)).alias("total_traffic_samples"),
        S.parse_iso(F.col("updated")).alias("last_learning_update"),
        S.parse_iso(F.col("changed")).alias("state_changed_at"),
    )
