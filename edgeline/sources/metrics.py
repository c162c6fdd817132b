"""Metric payloads (time series per load balancer) -> one-minute bucket rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import jsontext as X
from edgeline.functions import scalars as S
from edgeline.functions.jsonvals import integer_text, strip

KEYS = ["tenant_id", "lb_namespace", "lb_name"]

# Series names and the counter each one fills. Fixed values.
WAF_SERIES = {
    "loadbalancer.request_count": "request_count",
    "loadbalancer.waf_blocked_count": "blocked_count",
    "loadbalancer.waf_monitored_count": "monitored_count",
    "loadbalancer.error_count": "error_count",
}
WAF_FLAT = {
    "request_count": "request_count",
    "waf_blocked_count": "blocked_count",
    "waf_monitored_count": "monitored_count",
    "error_count": "error_count",
}
BOT_SERIES = {
    "loadbalancer.bot_request_count": "request_count",
    "loadbalancer.bot_challenge_count": "challenge_count",
    "loadbalancer.bot_block_count": "block_count",
    "loadbalancer.bot_allow_count": "allow_count",
}
API_COUNTS = {
    "loadbalancer.request_count": "request_count",
    "loadbalancer.http_4xx_count": "error_4xx_count",
    "loadbalancer.http_5xx_count": "error_5xx_count",
}
API_LATENCIES = {
    "loadbalancer.latency_p50": "latency_p50_ms",
    "loadbalancer.latency_p95": "latency_p95_ms",
    "loadbalancer.latency_p99": "latency_p99_ms",
}


# a cell: [time text, one value]; anything else is not a pair
PAIR = r'^\[\s*"([^"\\]*)"\s*,\s*("[^"\\]*"|[^\[\]{},"\s]+)\s*\]$'


def _series(raw: DataFrame, fields: list[str]) -> DataFrame:
    """One row per entry of ``data`` with the named fields, keeping its position.

    When one batch holds two documents for a load balancer the one landed later
    wins; a digest decides between documents landed at one time.
    """
    data = F.from_json(X.unwrapped(F.col("payload")), "struct<data: array<string>>")["data"]
    order = F.struct("landed_at", F.xxhash64("payload").alias("digest"))
    entries = raw.select(*KEYS, order.alias("doc_no"), F.posexplode(data).alias("at", "item"))
    return X.pull(entries, F.col("item"), fields)


def _series_cells(table: dict[str, str]) -> Column:
    """``values=[[ts, value], ...]`` of a known series as (time, counter, value) texts."""
    name = S.lookup(F.col("j_metric"), table)
    cells = F.transform(
        X.elements(F.col("j_values")),
        lambda c: F.struct(
            F.regexp_extract(c, PAIR, 1).alias("ts"),
            name.alias("name"),
            F.regexp_extract(c, PAIR, 2).alias("value"),
        ),
    )
    return F.when(name.isNotNull(), cells)


def _member(value: Column) -> Column:
    """A marked counter as JSON text: what looked like a decimal but was a string is quoted again."""
    return F.when(value.startswith(X.MARK), F.concat(F.lit('"'), X.plain(value), F.lit('"'))).otherwise(value)


def _flat_cells(table: dict[str, str]) -> Column:
    """``{bucket_time, counter: value, ...}`` of the flat shape, in the same form."""
    ts = X.first_plain(F.col("j_bucket_time"), F.col("j_timestamp"))
    return F.array(
        *[
            F.struct(
                ts.alias("ts"),
                F.lit(column).alias("name"),
                _member(F.col(f"f_{field}")).alias("value"),
            )
            for field, column in table.items()
        ]
    )


def _cells(series: DataFrame, cells: Column, extra: list[str] = ()) -> DataFrame:
    one = series.select(*KEYS, *extra, "doc_no", "at", F.posexplode(cells).alias("pos", "cell"))
    return one.select(
        *KEYS,
        *extra,
        F.struct("doc_no", "at", "pos").alias("seq"),
        S.parse_iso(F.col("cell.ts")).alias("bucket_time"),
        F.col("cell.name").alias("name"),
        F.col("cell.value").alias("value"),
    ).filter(F.col("bucket_time").isNotNull())


def _unquoted(v: Column) -> Column:
    return F.btrim(v, F.lit('"'))


def _whole(v: Column) -> Column:
    """Numbers truncate; strings must hold a whole number."""
    number = F.when(~v.startswith('"'), v.try_cast("double").try_cast("bigint"))
    return F.coalesce(integer_text(_unquoted(v)), number)


def _real(v: Column) -> Column:
    return strip(_unquoted(v)).try_cast("double")


def _last(value: Column, name: str) -> Column:
    """Latest cell of one series in a bucket (a later cell overwrites an earlier one)."""
    return F.max_by(value, F.when(F.col("name") == name, F.col("seq")))


def _counters(cells: DataFrame, names: list[str]) -> DataFrame:
    rows = cells.withColumn("n", _whole(F.col("value"))).filter(F.col("n").isNotNull())
    return rows.groupBy("bucket_time", *KEYS).agg(
        *[F.coalesce(_last(F.col("n"), c), F.lit(0)).cast("bigint").alias(c) for c in names],
        F.max("seq.doc_no.landed_at").alias("landed_at"),
    )


def waf_metric_buckets(raw: DataFrame) -> DataFrame:
    """Firewall counters per (bucket, load balancer), from either payload shape."""
    series = _series(raw, ["metric", "values", "bucket_time", "timestamp"])
    is_series = F.col("j_metric").isNotNull() | F.col("item").contains('"metric":null')
    # the members of the item itself; nested ones of the same name are no counters
    flat = F.when(~is_series, X.marked(F.col("item"), decimals=True))
    series = X.pull(series, flat, list(WAF_FLAT), "f_")
    cells = F.when(is_series, _series_cells(WAF_SERIES)).otherwise(_flat_cells(WAF_FLAT))
    return _counters(_cells(series, cells), list(WAF_SERIES.values()))


def bot_metric_buckets(raw: DataFrame, load_balancers: DataFrame | None = None) -> DataFrame:
    """Bot counters per (bucket, load balancer); only where bot defense is on."""
    if load_balancers is not None:
        from edgeline.sources.events import protected_lb_scope

        raw = protected_lb_scope(raw, load_balancers, "has_bot_defense")
    cells = _cells(_series(raw, ["metric", "values"]), _series_cells(BOT_SERIES))
    return _counters(cells, list(BOT_SERIES.values()))


def api_metric_buckets(raw: DataFrame) -> DataFrame:
    """Per (bucket, load balancer, method, endpoint): counts and latency percentiles."""
    series = X.pull(
        _series(raw, ["metric", "labels", "values"]),
        F.when(X.is_object(F.col("j_labels")), F.col("j_labels")),
        ["method", "endpoint", "path"],
        "l_",
    )
    path = strip(X.first(F.col("l_endpoint"), F.col("l_path")))
    named = X.fixed(
        series,
        {
            "method": strip(F.upper(X.given(F.col("l_method")))),
            "endpoint_path": S.blank_to_null(path),
        },
        [*KEYS, "doc_no", "at", "j_metric", "j_values"],
    ).filter((F.col("method") != "") & F.col("endpoint_path").isNotNull())
    cells = _cells(named, _series_cells({**API_COUNTS, **API_LATENCIES}), ["method", "endpoint_path"])
    n = F.coalesce(_whole(F.col("value")), F.lit(0))
    # a bad latency overwrites an earlier good one with null, so rank the wrapped value
    ms = F.struct(_real(F.col("value")).alias("ms"))
    return cells.groupBy("bucket_time", *KEYS, "method", "endpoint_path").agg(
        *[
            F.coalesce(_last(n, c), F.lit(0)).cast("bigint").alias(c)
            for c in API_COUNTS.values()
        ],
        *[_last(ms, c)["ms"].alias(c) for c in API_LATENCIES.values()],
        F.max("seq.doc_no.landed_at").alias("landed_at"),
    )
