"""Cross-signal queries: correlation of firewall and bot rows per attacker."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions import paging
from edgeline.functions.paging import Cursor
from edgeline.functions.ranking import commonest, top_per_group
from edgeline.functions.timewin import DATE_COLUMNS, AsOf, bucket, moment, span, within

ATTACKER = ["tenant_id", "source_ip", "source_asn", "source_country"]


def _is(*actions: str) -> Column:
    return F.col("action").isin(*actions)


def _client_error() -> Column:
    return F.coalesce(F.col("response_code").between(400, 499), F.lit(False))


def attack_signals(waf: DataFrame, bot: DataFrame) -> DataFrame:
    """Firewall and bot rows in one shape, each with the counters it adds to."""
    zero = F.lit(False)
    w = waf.select(
        *ATTACKER,
        "event_time",
        F.concat_ws("/", "lb_namespace", "lb_name").alias("lb"),
        F.col("url").alias("endpoint"),
        F.col("primary_signature").alias("signature"),
        _is("BLOCK").alias("waf_block"),
        _is("MONITOR").alias("waf_monitor"),
        zero.alias("bot_block"),
        zero.alias("bot_challenge"),
        _client_error().alias("api_4xx"),
        (F.col("action") != "ALLOW").alias("hostile"),
    )
    b = bot.select(
        *ATTACKER,
        "event_time",
        F.concat_ws("/", "lb_namespace", "lb_name").alias("lb"),
        F.col("endpoint_path").alias("endpoint"),
        F.lit(None).cast("string").alias("signature"),
        zero.alias("waf_block"),
        zero.alias("waf_monitor"),
        _is("BLOCK").alias("bot_block"),
        _is("CHALLENGE").alias("bot_challenge"),
        zero.alias("api_4xx"),
        _is("BLOCK", "CHALLENGE", "MONITOR").alias("hostile"),
    )
    return w.unionByName(b)


COUNTERS = ["waf_block", "waf_monitor", "bot_block", "bot_challenge", "api_4xx"]


def signals_by_value(signals: DataFrame, *more: Column) -> DataFrame:
    """Signals counted per attacker and load balancer, endpoint and signature (``kind``, ``value``), and ``more``."""
    hostile = F.col("hostile")

    def part(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    def attacked(name: str) -> Column:
        return F.when(hostile & (F.col(name) != ""), F.col(name))

    parts = F.array(
        part("lb", F.col("lb")),
        part("endpoint", attacked("endpoint")),
        part("signature", attacked("signature")),
    )
    seen = F.when(hostile, F.col("event_time"))
    return (
        signals.select(*ATTACKER, "event_time", "hostile", *COUNTERS, F.inline(parts))
        .filter((F.col("kind") == "lb") | F.col("value").isNotNull())
        .groupBy(*ATTACKER, "kind", "value", *more)
        .agg(
            F.count_if(hostile).alias("n"),
            *[F.count_if(c).alias(c) for c in COUNTERS],
            F.min(seen).alias("first"),
            F.max(seen).alias("last"),
        )
    )


def profiles_of(by_value: DataFrame) -> DataFrame:
    """Profiles from one row per attacker, kind and value."""
    whole = F.col("kind") == "lb"

    def top(kind: str) -> Column:
        return commonest(F.when(F.col("kind") == kind, F.col("value")), F.col("n"))

    profiles = by_value.groupBy(*ATTACKER).agg(
        *[F.sum(F.when(whole, F.col(c))).alias(f"{c}_count") for c in COUNTERS],
        top("endpoint").alias("top_endpoint"),
        top("signature").alias("top_signature"),
        F.count_if(whole & (F.col("n") > 0)).alias("distinct_lbs"),
        F.min("first").alias("first_seen_at"),
        F.max("last").alias("last_seen_at"),
    )
    total = sum((F.col(f"{c}_count") for c in COUNTERS[1:]), F.col(f"{COUNTERS[0]}_count"))
    return profiles.withColumn("total_events", total)


def known_address() -> Column:
    return F.coalesce(F.col("source_ip") != "", F.lit(False))


def attacker_hours(waf: DataFrame, bot: DataFrame) -> DataFrame:
    """``signals_by_value`` for every hour: counts that add up over hours to those of any span of whole hours."""
    signals = attack_signals(waf.filter(known_address()), bot.filter(known_address()))
    return signals_by_value(signals, bucket("event_time", "1 hour").alias("signal_hour"))


def added_up(by_hour: DataFrame) -> DataFrame:
    """The rows of many hours as one per attacker, kind and value."""
    return by_hour.groupBy(*ATTACKER, "kind", "value").agg(
        *[F.sum(c).alias(c) for c in ("n", *COUNTERS)], F.min("first").alias("first"), F.max("last").alias("last")
    )


def attacker_correlation_from_hours(
    hours: DataFrame,
    waf: DataFrame,
    bot: DataFrame,
    *,
    as_of: AsOf,
    window: timedelta = timedelta(minutes=settings.PROFILE_WINDOW_MINUTES),
) -> DataFrame:
    """``attacker_correlation`` from stored ``attacker_hours``: whole hours from there, the two hours at the ends from the events."""
    end = moment(waf, "event_time", as_of)
    start = end - span(window)
    kind = waf.schema["event_time"].dataType
    first = F.date_trunc("hour", start + F.expr("INTERVAL '3599.999999' SECOND")).cast(kind)
    final = F.date_trunc("hour", end).cast(kind)
    whole = (F.col("signal_hour") >= first) & (F.col("signal_hour") < final)
    day = DATE_COLUMNS["signal_hour"]
    if day in hours.columns:
        whole &= F.col(day).between(first.cast("date"), final.cast("date"))

    def ends(df: DataFrame) -> DataFrame:
        t = F.col("event_time")
        rows = df.filter((t >= start) & (t <= end) & ((t < first) | (t >= final)) & known_address())
        day = DATE_COLUMNS["event_time"]
        if day in df.columns:
            rows = rows.filter(F.col(day).isin(start.cast("date"), first.cast("date"), end.cast("date")))
        return rows

    cols = [*ATTACKER, "kind", "value", "n", *COUNTERS, "first", "last"]
    edges = signals_by_value(attack_signals(ends(waf), ends(bot)))
    return profiles_of(added_up(hours.filter(whole).select(*cols).unionByName(edges.select(*cols))))


def attacker_correlation(
    waf: DataFrame,
    bot: DataFrame,
    *,
    as_of: AsOf,
    window: timedelta = timedelta(minutes=settings.PROFILE_WINDOW_MINUTES),
    max_attackers: int | None = None,
    drop_zero: bool = False,
) -> DataFrame:
    """Per (address, ASN, country): counters of every signal and what was attacked.

    Each row is counted under its load balancer, its endpoint and its signature.
    The first shuffle groups by (attacker, kind, value), which spreads one very
    busy address over everything it touched; the second sees only the partial
    sums. Two shuffles in all, no join, and nothing collected. An address with
    allowed rows only keeps a zero row unless ``drop_zero`` is set. A blocked
    403 counts as a block and as a client error. All profiles are returned, or
    the busiest ``max_attackers`` of each tenant where that is asked for.
    """
    recent = [
        within(df, "event_time", as_of, window, to_second=False).filter(
            F.col("source_ip").isNotNull() & (F.col("source_ip") != "")
        )
        for df in (waf, bot)
    ]
    profiles = profiles_of(signals_by_value(attack_signals(*recent)))
    if drop_zero:
        profiles = profiles.filter(F.col("total_events") > 0)
    if max_attackers is None:
        return profiles
    order = [
        F.desc("total_events"),
        F.asc("source_ip"),
        F.asc_nulls_first("source_asn"),
        F.asc_nulls_first("source_country"),
    ]
    return top_per_group(
        profiles, ["tenant_id"], order, max_attackers
    )


def security_overview(
    profiles: DataFrame,
    waf: DataFrame,
    bot: DataFrame,
    alerts: DataFrame,
    *,
    as_of: AsOf,
    minutes: int = 1440,
) -> DataFrame:
    """One row per tenant. Profiles and alerts count over all time, events in the window."""
    back = timedelta(minutes=minutes)
    recent_waf = within(waf, "event_time", as_of, back, upper=False, to_second=False)
    recent_bot = within(bot, "event_time", as_of, back, upper=False, to_second=False)

    attackers = (
        profiles.groupBy("tenant_id", "source_country")
        .agg(F.count("*").alias("n"))
        .groupBy("tenant_id")
        .agg(F.sum("n").alias("total_attackers"), F.count("source_country").alias("countries_seen"))
    )
    by_country = recent_waf.groupBy("tenant_id", "source_country").agg(
        F.count_if(_is("BLOCK")).alias("blocks"),
        F.count_if(_is("BLOCK", "MONITOR")).alias("n"),
        F.count_if(_client_error()).alias("e4"),
    )
    top = F.min(
        F.when(
            F.col("source_country").isNotNull() & (F.col("n") > 0),
            F.struct((-F.col("n")).alias("n"), F.col("source_country").alias("v")),
        )
    )
    firewall = by_country.groupBy("tenant_id").agg(
        top["v"].alias("top_country"),
        (-top["n"]).alias("top_country_count"),
        F.sum("blocks").alias("total_waf_blocks"),
        F.sum("e4").alias("total_api_4xx"),
    )
    bots = recent_bot.groupBy("tenant_id").agg(
        F.count_if(_is("BLOCK", "CHALLENGE")).alias("total_bot_interventions")
    )
    is_open = F.col("status") == "open"
    raised = alerts.groupBy("tenant_id").agg(
        F.count_if(is_open).alias("open_alerts"),
        F.count_if(is_open & (F.col("severity") == "critical")).alias("critical_alerts"),
    )
    out = attackers
    for part in (firewall, bots, raised):
        out = out.join(part, "tenant_id", "full_outer")
    counts = [c for c in out.columns if c not in ("tenant_id", "top_country")]
    return out.fillna(0, counts)


def geo_counts(
    waf: DataFrame, bot: DataFrame, *, as_of: AsOf, hours: int = 24, signal: str = "all"
) -> DataFrame:
    """Hostile rows per country over one or both signals."""
    back = timedelta(hours=hours)
    parts = []
    if signal in ("all", "waf"):
        rows = within(waf, "event_time", as_of, back, upper=False, to_second=False)
        parts.append(rows.filter(_is("BLOCK", "MONITOR")))
    if signal in ("all", "bot"):
        rows = within(bot, "event_time", as_of, back, upper=False, to_second=False)
        parts.append(rows.filter(_is("BLOCK", "CHALLENGE", "MONITOR")))
    if not parts:
        raise ValueError(f"unknown signal {signal}")
    cols = ["tenant_id", F.col("source_country").alias("country")]
    rows = parts[0].select(*cols)
    for other in parts[1:]:
        rows = rows.unionByName(other.select(*cols))
    return (
        rows.filter(F.col("country").isNotNull())
        .groupBy("tenant_id", "country")
        .agg(F.count("*").alias("count"))
        .orderBy("tenant_id", F.desc("count"), "country")
    )


def attacker_keys(sort: str) -> list[paging.Key]:
    value = {
        "total": paging.Key("total_events", True),
        "waf": paging.Key("waf", True, F.col("waf_block_count") + F.col("waf_monitor_count")),
        "bot": paging.Key("bot", True, F.col("bot_block_count") + F.col("bot_challenge_count")),
        "last_seen": paging.Key("last_seen_at", True),
    }[sort]
    return [value, *[paging.Key(c) for c in ("source_ip", "source_asn", "source_country")]]


def attacker_list(
    profiles: DataFrame,
    *,
    country: str | None = None,
    sort: str = "total",
    limit: int = 50,
    offset: int = 0,
    after: Cursor = None,
) -> DataFrame:
    """One page of profiles per tenant, behind an offset or a cursor of ``attacker_keys``; nulls come first."""
    rows = profiles
    if country:
        rows = rows.filter(F.col("source_country") == country.upper())
    return paging.page(rows, ["tenant_id"], attacker_keys(sort), limit, offset=offset, at=after)


def attacker_timeline(
    waf: DataFrame,
    bot: DataFrame,
    *,
    as_of: AsOf,
    source_ip: str | None = None,
    window: timedelta = timedelta(hours=24),
    limit: int = settings.TIMELINE_LIMIT,
) -> DataFrame:
    """Newest firewall and bot rows of an address, merged; all addresses when none is given.

    The newest ``limit`` of the union are the newest of the two newest lists.
    """

    def rows(df: DataFrame) -> DataFrame:
        out = within(df, "event_time", as_of, window, to_second=False)
        return out.filter(
            F.col("source_ip") == source_ip if source_ip else F.col("source_ip").isNotNull()
        )

    shared = ["tenant_id", "source_ip", "event_time", "id", "action", "lb_name", "method"]
    w = rows(waf).select(
        *shared,
        F.lit("waf").alias("signal"),
        F.col("url").alias("endpoint"),
        F.col("primary_signature").alias("classifier"),
        F.col("response_code").alias("rsp_code"),
        "severity",
    )
    b = rows(bot).select(
        *shared,
        F.lit("bot").alias("signal"),
        F.col("endpoint_path").alias("endpoint"),
        F.col("bot_category").alias("classifier"),
        F.struct("confidence_score", "challenge_result").alias("extra"),
    )
    merged = w.unionByName(b, allowMissingColumns=True)
    order = [F.desc("event_time"), F.desc("signal"), F.asc("id")]
    return top_per_group(merged, ["tenant_id", "source_ip"], order, limit)
