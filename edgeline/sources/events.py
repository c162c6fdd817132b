"""Raw firewall and bot records -> typed event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import jsontext as X
from edgeline.functions import scalars as S

KEYS = ["tenant_id", "lb_namespace", "lb_name"]

# Field names a record may use. Fixed values.
COMMON_FIELDS = [
    "@timestamp",
    "event_time",
    "timestamp",
    "time",
    "req_id",
    "request_id",
    "vh_name",
    "action",
    "src_ip",
    "source_ip",
    "country",
    "src_country",
    "source_country",
    "asn",
    "src_asn",
    "source_asn",
    "method",
    "req_path",
    "url",
    "user_agent",
    "sec_event_name",
    "sec_event_type",
]
WAF_FIELDS = [
    "rsp_code",
    "response_code",
    "violation_name",
    "primary_signature",
    "violation_ids",
    "signature_ids",
    "threat_categories",
    "severity",
    "waf_policy",
]
BOT_FIELDS = [
    "bot_defense",
    "bot_classification",
    "bot_category",
    "bot_score",
    "bot_policy",
    "classification",
    "confidence_score",
    "challenge",
    "challenge_type",
    "challenge_result",
    "device_anomalies",
    "device_fingerprint_anomalies",
    "endpoint",
]
CHALLENGE_RESULTS = ["passed", "failed", "abandoned", "not_issued"]
BOT_EVENT_TYPE = "bot_defense_sec_event"


def _j(name: str) -> Column:
    return F.col(f"`j_{name}`")


def _first(*names: str) -> Column:
    return X.first_plain(*[_j(n) for n in names])


def _is_bot() -> Column:
    typed = F.coalesce(_j("sec_event_type") == BOT_EVENT_TYPE, F.lit(False))
    fields = ("bot_defense", "bot_classification", "bot_category", "bot_score")
    return typed | F.greatest(*[X.truthy(_j(n)) for n in fields])


def _common() -> dict[str, Column]:
    """Values every event row needs, chosen among their spellings."""
    parts = [
        F.coalesce(X.plain(_j(n)), F.lit(""))
        for n in ("@timestamp", "src_ip", "req_path", "method", "vh_name")
    ]
    return {
        "t_time": _first("@timestamp", "event_time", "timestamp", "time"),
        "t_request": _first("req_id", "request_id"),
        "t_digest": F.concat_ws("|", *parts),
        "source_ip": _first("src_ip", "source_ip"),
        "source_country": _first("country", "src_country", "source_country"),
        "t_asn": _first("asn", "src_asn", "source_asn"),
        "method": X.plain(_j("method")),
        "t_agent": _first("user_agent"),
    }


def _rows(df: DataFrame, chosen: dict[str, Column], cols: list[Column]) -> DataFrame:
    """Choose values once, drop rows without a readable time, compute the columns."""
    landed = [c for c in ("landed_at",) if c in df.columns]
    raw = [*KEYS, *landed, "payload"]
    picked = X.fixed(df, {**_common(), **chosen}, raw)
    timed = picked.withColumn("event_time", S.parse_iso(F.col("t_time")))
    return timed.filter(F.col("event_time").isNotNull()).select(
        "event_time",
        S.stable_event_id(F.col("t_request"), F.col("t_digest")).alias("id"),
        *KEYS,
        *cols,
        *landed,
        F.col("payload").alias("raw_event"),
    )


def _origin() -> list[Column]:
    return [
        F.col("source_ip"),
        F.col("source_country"),
        S.parse_asn(F.col("t_asn")).alias("source_asn"),
        F.col("method"),
    ]


def waf_events_from_raw(raw: DataFrame, *, exclude_bot: bool = False) -> DataFrame:
    """Firewall rows; records without a readable time, or not JSON, are dropped.

    Bot records are kept, as the firewall feed is not filtered by type;
    ``exclude_bot`` leaves them to the bot table alone.
    """
    names = COMMON_FIELDS + WAF_FIELDS
    if exclude_bot:
        names = names + ["bot_defense", "bot_classification", "bot_category", "bot_score"]
    df = X.records(raw, names, filtered=exclude_bot)
    if exclude_bot:
        df = df.filter(~_is_bot())
    policy = X.given(_j("waf_policy"))
    fields = X.struct_of(["namespace", "name"])
    chosen = {
        "t_action": _first("action"),
        "t_path": _first("req_path", "url"),
        "t_code": X.either(_j("rsp_code"), _j("response_code")),
        "primary_signature": _first("sec_event_name", "violation_name", "primary_signature"),
        "signature_ids": X.plain_json(X.first(_j("violation_ids"), _j("signature_ids"))),
        "threat_categories": X.plain_json(
            X.first(_j("sec_event_type"), _j("threat_categories"))
        ),
        "severity": X.plain(_j("severity")),
        "t_policy": policy,
        "t_fields": F.when(X.is_object(policy), F.from_json(policy, fields)),
        "t_event_name": X.plain(_j("sec_event_name")),
    }
    as_object, as_text = F.col("t_fields").isNotNull(), F.col("t_policy").isNotNull()
    return _rows(
        df,
        chosen,
        [
            S.waf_action(F.col("t_action")).alias("action"),
            *_origin(),
            S.blank_to_null(F.col("t_path")).alias("url"),
            S.blank_to_null(F.col("t_agent")).alias("user_agent"),
            X.whole(F.col("t_code")).cast("int").alias("response_code"),
            F.col("primary_signature"),
            F.col("signature_ids"),
            F.col("threat_categories"),
            F.col("severity"),
            F.when(as_object, X.plain(F.col("t_fields.namespace")))
            .when(as_text, F.col("lb_namespace"))
            .alias("waf_policy_namespace"),
            F.when(as_object, X.plain(F.col("t_fields.name")))
            .when(as_text, F.col("t_event_name"))
            .alias("waf_policy_name"),
        ],
    )


def bot_filter(raw: DataFrame) -> DataFrame:
    """Raw records that describe a bot decision."""
    names = ["sec_event_type", "bot_defense", "bot_classification", "bot_category", "bot_score"]
    return X.records(raw, names, filtered=True).filter(_is_bot()).select(*raw.columns)


def _bot_columns(
    source: str, category: Column, result: Column, kind: Column, anomalies: Column, policy: Column
) -> list[Column]:
    score = X.score(F.col("t_score"))
    return [
        F.lit(source).alias("source"),
        F.col("action"),
        S.bot_category(category).alias("bot_category"),
        S.confidence_bucket(score).alias("confidence_bucket"),
        score.cast("int").alias("confidence_score"),
        result.alias("challenge_result"),
        kind.alias("challenge_type"),
        anomalies.alias("device_anomalies"),
        *_origin(),
        S.blank_to_null(F.col("t_path")).alias("endpoint_path"),
        S.blank_to_null(F.col("t_agent")).alias("user_agent"),
        S.ua_family(F.col("t_agent")).alias("ua_family"),
        policy["namespace"].alias("bot_policy_namespace"),
        policy["name"].alias("bot_policy_name"),
    ]


def bot_events_standard(raw: DataFrame) -> DataFrame:
    """Bot rows from the shared security feed; records that are not bot events are dropped."""
    df = X.records(raw, COMMON_FIELDS + BOT_FIELDS, filtered=True).filter(_is_bot())
    names = [
        "action",
        "bot_classification",
        "automation_type",
        "insight",
        "bot_score",
        "challenge",
        "policy",
    ]
    df = X.pull(df, F.when(X.is_object(_j("bot_defense")), _j("bot_defense")), names, "d_")
    refs = X.struct_of(["namespace", "name"])
    policy = X.first(_j("bot_policy"), F.col("d_policy"))
    challenge = X.given(F.col("d_challenge"))
    chosen = {
        "action": S.bot_action(X.first_plain(F.col("d_action"), _j("action"))),
        "t_category": X.first_plain(
            F.col("d_bot_classification"),
            F.col("d_automation_type"),
            F.col("d_insight"),
            _j("bot_classification"),
            _j("bot_category"),
            _j("sec_event_name"),
        ),
        "t_score": X.either(F.col("d_bot_score"), _j("bot_score")),
        "t_challenge": F.from_json(
            F.when(X.is_object(challenge), challenge), X.struct_of(["type", "result"])
        ),
        "t_unreadable": F.coalesce(~X.is_object(challenge) & challenge.isNotNull(), F.lit(False)),
        "t_path": _first("req_path", "url"),
        "t_policy": F.from_json(F.when(X.is_object(policy), policy), refs),
        "t_event_name": X.plain(_j("sec_event_name")),
    }
    challenged = F.col("action") == "CHALLENGE"
    outcome = F.coalesce(F.lower(X.first_plain(F.col("t_challenge.result"))), F.lit("abandoned"))
    owner = F.struct(
        F.coalesce(X.first_plain(F.col("t_policy.namespace")), F.col("lb_namespace")).alias(
            "namespace"
        ),
        F.coalesce(X.first_plain(F.col("t_policy.name")), F.col("t_event_name")).alias("name"),
    )
    return _rows(
        df,
        chosen,
        _bot_columns(
            "standard",
            F.col("t_category"),
            F.when(challenged & ~F.col("t_unreadable"), outcome).otherwise(F.lit("not_issued")),
            F.when(challenged, X.plain(F.col("t_challenge.type"))),
            F.lit(None).cast("array<string>"),
            owner,
        ),
    )


def bot_events_advanced(raw: DataFrame) -> DataFrame:
    """Bot rows from the dedicated feed with scores, challenges and device anomalies."""
    df = X.records(raw, COMMON_FIELDS + BOT_FIELDS)
    df = X.pull(df, F.when(X.is_object(_j("challenge")), _j("challenge")), ["type", "result"], "c_")
    refs = X.struct_of(["namespace", "name"])
    anomalies = X.first(_j("device_anomalies"), _j("device_fingerprint_anomalies"))
    chosen = {
        "action": S.bot_action(_first("action")),
        "t_category": _first("bot_category", "classification"),
        "t_score": X.either(_j("confidence_score"), _j("bot_score")),
        "t_result": F.lower(X.first_plain(F.col("c_result"), _j("challenge_result"))),
        "t_kind": X.first_plain(F.col("c_type"), _j("challenge_type")),
        "t_anomalies": X.elements(anomalies),
        "t_path": _first("req_path", "url", "endpoint"),
        "t_policy": F.from_json(
            F.when(X.is_object(_j("bot_policy")), _j("bot_policy")), refs
        ),
    }
    result = F.col("t_result")
    return _rows(
        df,
        chosen,
        _bot_columns(
            "bd_advanced",
            F.col("t_category"),
            F.when(result.isNull() & (F.col("action") == "CHALLENGE"), F.lit("abandoned"))
            .when(result.isin(CHALLENGE_RESULTS), result)
            .otherwise(F.lit("not_issued")),
            F.col("t_kind"),
            F.transform(F.col("t_anomalies"), X.plain),
            F.struct(
                X.plain(F.col("t_policy.namespace")).alias("namespace"),
                X.plain(F.col("t_policy.name")).alias("name"),
            ),
        ),
    )


def bot_events(standard_raw: DataFrame, advanced_raw: DataFrame) -> DataFrame:
    """Both bot feeds as one table."""
    return bot_events_standard(standard_raw).unionByName(bot_events_advanced(advanced_raw))


def protected_lb_scope(raw: DataFrame, load_balancers: DataFrame, flag: str) -> DataFrame:
    """Raw records of load balancers that have the given protection switched on."""
    wanted = load_balancers.filter(F.col(flag)).select(
        "tenant_id", F.col("namespace").alias("lb_namespace"), F.col("name").alias("lb_name")
    )
    return raw.join(wanted, KEYS, "left_semi")
