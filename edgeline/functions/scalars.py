"""Scalar column functions: parsing, normalising and classifying one value."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeline.functions import jsonvals as J

# --- fixed values ----------------------------------------------------------
# Unordered maps and sets are sorted by key.

# User-agent families, tried in this order, case-insensitive.
UA_FAMILIES = [
    (r"Googlebot|Google-InspectionTool|AdsBot-Google", "googlebot"),
    (r"bingbot", "bingbot"),
    (r"DuckDuckBot|Slurp|Yandex|Baiduspider", "search_other"),
    (r"curl/", "curl"),
    (r"Wget/", "wget"),
    (r"python-requests/|aiohttp/|urllib", "python_http"),
    (r"Go-http-client|okhttp/|Java/|Apache-HttpClient", "language_runtime"),
    (r"PostmanRuntime|Insomnia/|Thunder Client", "api_tool"),
    (r"HeadlessChrome|PhantomJS|Selenium|Puppeteer|Playwright", "headless_browser"),
    (r"Mozilla.*Chrome/", "chrome"),
    (r"Mozilla.*Firefox/", "firefox"),
    (r"Mozilla.*Safari/.*Version/", "safari"),
    (r"Mozilla.*Edg/", "edge"),
]

BOT_CATEGORIES = [
    "good_bot",
    "bad_bot",
    "automation",
    "scraper",
    "data_center",
    "search_engine",
    "suspicious",
    "human",
    "unknown",
]

BOT_CATEGORY_ALIASES = {
    "account_takeover": "bad_bot",
    "automated_browser": "automation",
    "automation_tools": "automation",
    "bad": "bad_bot",
    "benign": "good_bot",
    "bot_defense_violation": "bad_bot",
    "credential_stuffing": "bad_bot",
    "data_center_bot": "data_center",
    "datacenter": "data_center",
    "datacenter_bot": "data_center",
    "good": "good_bot",
    "headless_browser": "automation",
    "malicious": "bad_bot",
    "scraping_bot": "scraper",
    "search_engine_bot": "search_engine",
    "token_missing": "bad_bot",
    "verified_search_engine": "search_engine",
    "web_scraper": "scraper",
    "web_scraping": "scraper",
}

WAF_ACTIONS = {"ALLOWED": "ALLOW", "BLOCKED": "BLOCK", "MONITORED": "MONITOR"}

BOT_ACTIONS = {
    "ALLOW": "ALLOW",
    "ALLOWED": "ALLOW",
    "BLOCK": "BLOCK",
    "BLOCKED": "BLOCK",
    "CAPTCHA_CHALLENGE": "CHALLENGE",
    "CHALLENGE": "CHALLENGE",
    "CHALLENGED": "CHALLENGE",
    "JS_CHALLENGE": "CHALLENGE",
    "MONITOR": "MONITOR",
    "MONITORED": "MONITOR",
}

AUTH_TYPES = ["none", "basic", "bearer", "oauth", "apikey", "unknown"]

AUTH_TYPE_ALIASES = {
    "anonymous": "none",
    "api_key": "apikey",
    "http_basic": "basic",
    "http_bearer": "bearer",
    "jwt": "bearer",
    "no_auth": "none",
    "oauth2": "oauth",
    "oauth_2": "oauth",
}

DISCOVERY_STATES = ["learning", "mature", "enforcing", "disabled", "unknown"]

DISCOVERY_STATE_ALIASES = {
    "active": "enforcing",
    "enforce": "enforcing",
    "in_learning": "learning",
    "matured": "mature",
    "off": "disabled",
    "stopped": "disabled",
}

ORIGIN_STATUSES = {
    "DRAINING": "info",
    "HEALTHY": "healthy",
    "STARTING": "warning",
    "UNHEALTHY": "unhealthy",
    "UNKNOWN": "warning",
}

SITE_TYPES = {
    "CE": "ce",
    "CUSTOMER_EDGE": "ce",
    "INGRESS_EGRESS_GATEWAY": "ig",
    "INGRESS_GATEWAY": "ig",
    "RE": "re",
    "REGIONAL_EDGE": "re",
    "VIRTUAL_SITE": "virtual",
}

SITE_NAME_PATTERN = r"^[a-z]{2,4}\d+-[a-z]{3}$"
UUID_PATTERN = r"^([0-9a-f]{32})$"

SHARED_NAMESPACE = "shared"
ALL_RE_SITES = "__all_re__"
VIRTUAL_PREFIX = "virtual:"

# --- helpers ---------------------------------------------------------------


def lookup(value: Column, table: dict[str, str]) -> Column:
    """Value of a small constant map, null when the key is not listed."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, value)


def blank_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def snake(s: Column) -> Column:
    return F.translate(F.lower(J.strip(s)), "- ", "__")


# --- the functions ---------------------------------------------------------


DAY = r"^\d{4}-\d{2}-\d{2}"
ZONE = r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)"


def parse_iso(s: Column) -> Column:
    """ISO-8601 text -> timestamp; no zone means UTC; anything else is null."""

    def filled(kept: int, rest: str) -> Column:
        """Short time completed to seconds, followed by its zone."""
        zone = F.coalesce(blank_to_null(F.substring(s, kept + 1, 9)), F.lit("Z"))
        return F.concat(F.left(s, F.lit(kept)), F.lit(rest), zone)

    dashes = (F.substring(s, 5, 1) == "-") & (F.substring(s, 8, 1) == "-")
    # the usual form needs no pattern: the parser itself checks the digits
    usual = dashes & s.endswith("Z") & (F.char_length(s) >= 20)
    full = (
        F.when(usual, s)
        .when(s.rlike(DAY + r"[T ]\d{2}:\d{2}:\d{2}.*" + ZONE + "$"), s)
        .when(s.rlike(DAY + r"[T ]\d{2}:\d{2}:\d{2}"), F.concat(s, F.lit("Z")))
        .when(s.rlike(DAY + "$"), F.concat(s, F.lit("T00:00:00Z")))
        .when(s.rlike(DAY + r"[T ]\d{2}:\d{2}" + ZONE + "?$"), filled(16, ":00"))
        .when(s.rlike(DAY + r"[T ]\d{2}" + ZONE + "?$"), filled(13, ":00:00"))
    )
    return F.try_to_timestamp(full)


def parse_asn(s: Column) -> Column:
    """``"12"`` -> 12, ``"Example Org (12)"`` -> 12, else null."""
    in_parens = blank_to_null(F.regexp_extract(s, r"\((\d+)\)", 1)).try_cast("bigint")
    return F.coalesce(in_parens, J.integer_text(s))


def parse_asn_value(v: Column) -> Column:
    """``parse_asn`` for a JSON value: numbers pass through."""
    return F.when(J.is_string(v), parse_asn(J.text(v))).otherwise(v.try_cast("bigint"))


def ua_family(ua: Column) -> Column:
    chain_ = F.when(ua.isNull() | (ua == ""), F.lit(None).cast("string"))
    for pattern, family in UA_FAMILIES:
        chain_ = chain_.when(ua.rlike(f"(?i){pattern}"), F.lit(family))
    return chain_.otherwise(F.lower(F.substring_index(ua, "/", 1)))


def bot_category(raw: Column) -> Column:
    name = F.coalesce(lookup(snake(raw), BOT_CATEGORY_ALIASES), snake(raw))
    return F.when(name.isin(BOT_CATEGORIES), name).otherwise(F.lit("unknown"))


def confidence_bucket(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unknown")
        .when(score >= 80, "high")
        .when(score >= 50, "medium")
        .otherwise("low")
    )


def waf_action(raw: Column) -> Column:
    up = blank_to_null(F.upper(raw))
    return F.coalesce(lookup(up, WAF_ACTIONS), up, F.lit("ALLOW"))


def bot_action(raw: Column) -> Column:
    return F.coalesce(lookup(F.upper(J.strip(raw)), BOT_ACTIONS), F.lit("ALLOW"))


def auth_type(raw: Column) -> Column:
    name = F.coalesce(lookup(snake(raw), AUTH_TYPE_ALIASES), snake(raw))
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string")).otherwise(
        F.when(name.isin(AUTH_TYPES), name).otherwise(F.lit("unknown"))
    )


def discovery_state(raw: Column) -> Column:
    low = F.lower(J.strip(raw))
    name = F.coalesce(lookup(low, DISCOVERY_STATE_ALIASES), low)
    return F.when(name.isin(DISCOVERY_STATES), name).otherwise(F.lit("unknown"))


def origin_status(raw: Column) -> Column:
    return F.coalesce(lookup(F.upper(raw), ORIGIN_STATUSES), F.lit("unknown"))


def site_type_from_name(name: Column) -> Column:
    return F.when(F.lower(name).rlike(SITE_NAME_PATTERN), "re").otherwise("unknown")


def site_type(raw: Column, name: Column) -> Column:
    return F.coalesce(lookup(F.upper(raw), SITE_TYPES), site_type_from_name(name))


def days_until(not_after: Column, as_of: Column) -> Column:
    """Whole days of the duration, rounded down, so just expired is -1."""
    end, now = not_after.cast("timestamp"), as_of.cast("timestamp")
    day = 86_400_000_000
    micros = F.unix_micros(end) - F.unix_micros(now)
    return F.floor(micros / F.lit(day)).cast("int")


def cert_status(days: Column, warn: int, critical: int) -> Column:
    return (
        F.when(days.isNull(), "unknown")
        .when(days < 0, "expired")
        .when(days <= critical, "critical")
        .when(days <= warn, "warn")
        .otherwise("ok")
    )


def lb_type(spec: Column) -> Column:
    return (
        F.when(J.present(J.key(spec, "https_auto_cert")), "https")
        .when(J.present(J.key(spec, "https")), "https")
        .when(J.present(J.key(spec, "http")), "http")
        .otherwise("unknown")
    )


def advertise_mode(spec: Column) -> Column:
    order = [
        "advertise_on_public_default_vip",
        "advertise_on_public",
        "advertise_custom",
        "do_not_advertise",
    ]
    return F.coalesce(*[F.when(J.present(J.key(spec, k)), F.lit(k)) for k in order])


def advertised_sites(spec: Column) -> Column:
    """Sites a load balancer is announced on; one marker stands for all RE sites."""

    def ref(entry: Column) -> Column:
        site = J.first_text(J.pick(entry, "$.site.site.name"))
        virtual = J.first_text(J.pick(entry, "$.virtual_site.virtual_site.name"))
        return F.when(J.present(J.key(entry, "site")), site).otherwise(
            F.concat(F.lit(VIRTUAL_PREFIX), virtual)
        )

    none = F.array().cast("array<string>")
    every = F.array(F.lit(ALL_RE_SITES))
    listed = F.filter(
        F.transform(J.items(J.pick(spec, "$.advertise_custom.advertise_where")), ref),
        lambda s: s.isNotNull(),
    )
    return (
        F.when(J.present(J.key(spec, "advertise_on_public_default_vip")), every)
        .when(J.present(J.key(spec, "do_not_advertise")), none)
        .when(J.present(J.key(spec, "advertise_on_public")), every)
        .when(J.present(J.key(spec, "advertise_custom")), listed)
        .otherwise(none)
    )


def origin_address(origin: Column) -> Column:
    """Address of one origin server, whichever of its six forms is used."""
    direct = J.first_text(
        J.pick(origin, "$.public_ip.ip"),
        J.pick(origin, "$.private_ip.ip"),
        J.pick(origin, "$.public_name.dns_name"),
        J.pick(origin, "$.private_name.dns_name"),
    )

    def service(kind: str, scheme: str) -> Column:
        name = J.text(J.pick(origin, f"$.{kind}.service_name"))
        return F.when(
            J.present(J.key(origin, kind)),
            F.concat(F.lit(scheme), F.coalesce(name, F.lit(""))),
        )

    return F.coalesce(
        direct,
        service("k8s_service", "k8s://"),
        service("consul_service", "consul://"),
        F.lit("unknown"),
    )


def as_uuid(hex32: Column) -> Column:
    """32 hex digits with the dashes of a UUID."""
    return F.regexp_replace(hex32, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def stable_event_id(request_id: Column, *parts: Column) -> Column:
    """The request id when it is a UUID, else a digest of the identifying fields."""
    bare = F.regexp_replace(F.lower(request_id), r"urn:|uuid:|[{}-]", "")
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    digest = F.substring(F.sha1(joined.cast("binary")), 1, 32)
    given = blank_to_null(F.regexp_extract(bare, UUID_PATTERN, 1))
    return as_uuid(F.coalesce(given, digest))


def truncate_text(s: Column, cap: int) -> Column:
    """At most ``cap`` characters, for display; stored columns and keys keep the whole text."""
    return blank_to_null(F.left(s, F.lit(cap)))


def is_shared(namespace: Column) -> Column:
    return F.coalesce(namespace == SHARED_NAMESPACE, F.lit(False))


def scope(namespace: Column) -> Column:
    return F.when(is_shared(namespace), "shared").otherwise("local")


def client_ip_from_forwarded(forwarded: Column, peer: Column) -> Column:
    """Leftmost address of a forwarded-for list, else the peer's address."""
    leftmost = blank_to_null(J.strip(F.substring_index(forwarded, ",", 1)))
    return F.when(forwarded.isNull() | (forwarded == ""), peer).otherwise(leftmost)
