"""Typed tables laid over the driver's parquet tables, as lazy views.

Each property is a column-wise or grouped derivation of whole tables; the SQL
of ``ctes`` derives the same tables independently for DuckDB.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline.functions import scalars as S
from edgeline.functions.timewin import latest
from edgeline.operators.joins import ORIGIN
from edgeline.session import use_utc

COUNTRIES = ["US", "DE", "FR", "GB", "NL", "BR", "IN", "JP"]
METHODS = ["GET", "POST", "PUT", "DELETE"]
AGENTS = [
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "Mozilla/5.0 (compatible; bingbot/2.0)",
    "DuckDuckBot/1.1",
    "curl/8.4.0",
    "Wget/1.21",
    "python-requests/2.31",
    "okhttp/4.9",
    "PostmanRuntime/7.36",
    "Mozilla/5.0 HeadlessChrome/120",
    "Mozilla/5.0 (X11) Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (X11) Firefox/121.0",
    "Mozilla/5.0 (Mac) Safari/605 Version/17",
    "CustomAgent/1.0",
]
AUTH = ["none", "basic", "bearer", "oauth", "apikey", "unknown"]
STATES = ["learning", "mature", "enforcing", "disabled", "unknown"]
POLICY_TYPES = ["app_firewall", "service_policy", "bot_defense_policy", "api_definition"]
CERT_AS_OF = "1998-06-01 00:00:00"


def word(prefix: str, *parts: Column | str) -> Column:
    return F.concat(
        F.lit(prefix), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


def nth(values: list[str], index: Column) -> Column:
    """values[index], null past the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        use_utc(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- events ------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    @cached_property
    def as_of(self) -> Column:
        """Newest event time as a scalar subquery: planned into each query, never fetched."""
        return latest(self.table("events"), "ts")

    def _address(self) -> list[Column]:
        u = F.col("user_id")
        ip = word("10.0.", F.floor(u / 256), ".", u % 256)
        return [
            F.when(u % 50 != 49, ip).alias("source_ip"),
            nth(COUNTRIES, u % 9).alias("source_country"),
            F.when(u % 7 != 6, u % 7 + 64500).alias("source_asn"),
        ]

    def _where(self) -> list[Column]:
        k = F.col("k")
        return [
            word("t", F.col("user_id") % 3).alias("tenant_id"),
            word("ns", k % 2).alias("lb_namespace"),
            word("lb-", k % 10).alias("lb_name"),
        ]

    @cached_property
    def waf_events(self) -> DataFrame:
        k, e, v = F.col("k"), F.col("event_type"), F.col("value")
        action = F.when(e == "error", "BLOCK").when(e == "signup", "MONITOR").otherwise("ALLOW")
        code = F.when(e == "error", F.when(k % 3 == 0, 403).when(k % 3 == 1, 404).otherwise(500))
        return self.events.select(
            "event_id",
            word("e", F.col("event_id")).alias("id"),
            F.col("ts").alias("event_time"),
            *self._where(),
            action.alias("action"),
            *self._address(),
            nth(METHODS, k % 4).alias("method"),
            word("/api/v", k % 5, "/r", k % 20).alias("url"),
            F.coalesce(code, F.lit(200)).alias("response_code"),
            F.when(action != "ALLOW", word("SIG_", k % 12)).alias("primary_signature"),
            F.when(v < 10, "low").when(v < 50, "medium").otherwise("high").alias("severity"),
            "k",
            "value",
        )

    @cached_property
    def bot_raw(self) -> DataFrame:
        """Bot events before normalisation, one per event."""
        k, e = F.col("k"), F.col("event_type")
        return self.events.select(
            "event_id",
            word("b", F.col("event_id")).alias("id"),
            F.col("ts").alias("event_time"),
            *self._where(),
            F.when(k % 8 == 0, "BLOCKED")
            .when(k % 8 == 2, "js_challenge")
            .when(k % 8 == 4, "MONITORED")
            .otherwise("ALLOWED")
            .alias("raw_action"),
            F.when(e == "signup", "token_missing")
            .when(e == "error", "good")
            .when(e == "click", "web-scraper")
            .when(e == "view", "automated browser")
            .otherwise("nonsense")
            .alias("raw_category"),
            F.when(k % 10 != 0, (F.floor("value") % 101)).cast("int").alias("confidence_score"),
            F.when(k % 3 == 0, "Failed").when(k % 3 == 1, "passed").alias("raw_result"),
            nth(AGENTS, k % 13).alias("user_agent"),
            F.when(k % 4 == 0, "standard").otherwise("bd_advanced").alias("source"),
            *self._address(),
            nth(METHODS, k % 4).alias("method"),
            word("/api/v", k % 5, "/r", k % 20).alias("endpoint_path"),
            "k",
        )

    @cached_property
    def bot_events(self) -> DataFrame:
        result = (
            F.when(F.col("source") == "standard", "not_issued")
            .when(F.col("raw_result").isNotNull(), F.lower("raw_result"))
            .when(F.col("action") == "CHALLENGE", "abandoned")
            .otherwise("not_issued")
        )
        return (
            self.bot_raw.withColumn("action", S.bot_action(F.col("raw_action")))
            .withColumn("bot_category", S.bot_category(F.col("raw_category")))
            .withColumn("confidence_bucket", S.confidence_bucket(F.col("confidence_score")))
            .withColumn("challenge_result", result)
            .withColumn("challenge_type", F.when(F.col("action") == "CHALLENGE", "js"))
            .withColumn("ua_family", S.ua_family(F.col("user_agent")))
            .drop("raw_action", "raw_category", "raw_result")
        )

    @cached_property
    def waf_metrics(self) -> DataFrame:
        from edgeline.operators.rollups import minute_metrics

        return minute_metrics(self.waf_events)

    @cached_property
    def bot_metrics(self) -> DataFrame:
        from edgeline.operators.rollups import bot_minute_metrics

        return bot_minute_metrics(self.bot_events)

    @cached_property
    def api_metrics(self) -> DataFrame:
        minute = F.window("event_time", "1 minute")["start"]
        code = F.col("response_code")
        return self.waf_events.groupBy(
            minute.alias("bucket_time"),
            "tenant_id",
            "lb_namespace",
            "lb_name",
            "method",
            F.col("url").alias("endpoint_path"),
        ).agg(
            F.count("*").alias("request_count"),
            F.count_if(code.between(400, 499)).alias("error_4xx_count"),
            F.count_if(code >= 500).alias("error_5xx_count"),
            *[
                F.percentile("value", q).alias(f"latency_p{int(q * 100)}_ms")
                for q in (0.5, 0.95, 0.99)
            ],
        )

    # --- load balancers seen in the events ----------------------------------

    @cached_property
    def event_lbs(self) -> DataFrame:
        """The load balancers the events belong to, with a small settings document each."""
        lbs = self.events.select(*self._where()).distinct()
        j = F.substring("lb_name", 4, 9).cast("int")
        empty = F.create_map().cast("map<string,string>")

        def ref(name: Column) -> Column:
            return F.struct(name.alias("name"), F.lit("shared").alias("namespace"))

        spec = F.struct(
            F.when(j % 2 == 0, ref(word("fw-", j % 3))).alias("app_firewall"),
            F.when(j % 3 == 0, F.struct(empty.alias("policy"), F.lit("on").alias("mode"))).alias(
                "bot_defense"
            ),
            F.when(
                j < 8, F.struct(F.array(ref(word("def-", j % 5))).alias("api_definitions"))
            ).alias("api_definition"),
        )
        return lbs.select(
            "tenant_id",
            F.col("lb_namespace").alias("namespace"),
            F.col("lb_name").alias("name"),
            (j % 2 == 0).alias("has_waf"),
            (j % 3 == 0).alias("has_bot_defense"),
            F.to_json(spec).alias("raw_spec"),
        )

    @cached_property
    def event_attachments(self) -> DataFrame:
        from edgeline.sources.policies import policy_attachments_from_lbs

        return policy_attachments_from_lbs(self.event_lbs)

    @cached_property
    def api_definition_docs(self) -> DataFrame:
        """API definitions per tenant, built from ``part``: paths r with r < 12."""
        r = F.col("p_partkey") % 20
        routes = self.table("part").select(r.alias("r")).distinct().filter("r < 12")
        member = F.struct(
            word("/api/v", F.col("r") % 5, "/r", F.col("r")).alias("key"),
            F.map_from_arrays(
                F.array(F.lower(nth(METHODS, F.col("r") % 4))),
                F.array(F.create_map().cast("map<string,string>")),
            ).alias("value"),
        )
        docs = routes.groupBy((F.col("r") % 5).alias("v")).agg(
            F.map_from_entries(F.collect_list(member)).alias("paths")
        )
        tenants = self.tenant_ids
        spec = F.struct(
            F.array(F.struct(F.struct("paths").alias("openapi_spec"))).alias("api_specs")
        )
        doc = F.struct(
            word("def-", F.col("v")).alias("name"),
            F.lit("shared").alias("namespace"),
            spec.alias("get_spec"),
        )
        keyed = docs.withColumn("tenant_id", F.explode(F.array(*[F.lit(f"t{i}") for i in range(3)])))
        return keyed.join(tenants, "tenant_id", "left_semi").select(
            "tenant_id", F.lit("shared").alias("namespace"), F.to_json(doc).alias("payload")
        )

    @cached_property
    def tenant_ids(self) -> DataFrame:
        return self.events.select(word("t", F.col("user_id") % 3).alias("tenant_id")).distinct()

    @cached_property
    def api_definitions(self) -> DataFrame:
        from edgeline.sources.policies import api_definition_config

        return api_definition_config(self.api_definition_docs)

    @cached_property
    def endpoint_stats(self) -> DataFrame:
        """Endpoints met in the events, before the shadow flag."""
        key = ["tenant_id", "lb_namespace", "lb_name", "method"]
        return (
            self.waf_events.groupBy(*key, F.col("url").alias("endpoint_path"))
            .agg(
                F.count("*").alias("total_request_samples"),
                F.min("event_time").alias("first_seen_at"),
                F.max("event_time").alias("last_seen_at"),
                F.array_sort(F.collect_set("response_code")).alias("response_codes"),
                (F.min("k") % 7).alias("a"),
            )
            .withColumn("auth_type", nth(AUTH, F.col("a")))
            .drop("a")
        )

    @cached_property
    def api_endpoints(self) -> DataFrame:
        from edgeline.operators.joins import shadow_detection

        return shadow_detection(self.endpoint_stats, self.event_attachments, self.api_definitions)

    @cached_property
    def states(self) -> DataFrame:
        j = F.substring("lb_name", 4, 9).cast("int")
        per_lb = self.waf_events.groupBy("tenant_id", "lb_namespace", "lb_name").agg(
            F.count("*").alias("total_traffic_samples"),
            F.count_distinct("url").alias("total_endpoints_discovered"),
        )
        ago = F.make_dt_interval(mins=j * 2)
        return per_lb.select(
            "*",
            nth(STATES, j % 5).alias("state"),
            F.when(j != 0, j * 10).alias("confidence_score"),
            (self.as_of - ago).alias("state_changed_at"),
        )

    # --- inventory over the TPC-H tables -------------------------------------

    @cached_property
    def certificates(self) -> DataFrame:
        k = F.col("o_orderkey")
        expiry = F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")
        return self.table("orders").select(
            word("t", F.col("o_custkey") % 3).alias("tenant_id"),
            word("ns", k % 4).alias("namespace"),
            word("cert-", k).alias("name"),
            word("CN", F.col("o_custkey")).alias("subject"),
            F.when(k % 11 != 0, expiry).alias("not_after"),
        )

    @cached_property
    def cert_as_of(self) -> Column:
        return F.lit(CERT_AS_OF).cast("timestamp_ntz")

    @cached_property
    def origin_pools(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            word("t", k % 3).alias("tenant_id"),
            word("p", k).alias("pool_id"),
            word("ns", k % 4).alias("namespace"),
            word("pool-", k).alias("name"),
            F.when(k % 2 == 0, 443).otherwise(80).alias("port"),
            nth(["ROUND_ROBIN", "LEAST_ACTIVE"], k % 3).alias("lb_algorithm"),
            (k % 5).cast("int").alias("origin_count"),
            F.lit(0).cast("bigint").alias("healthy_count"),
            (k % 2).alias("unhealthy_count"),
            F.lit(0).cast("bigint").alias("warning_count"),
            F.lit(None).cast("timestamp_ntz").alias("last_healthcheck_at"),
        )

    def _health(self, pool: Column, tenant: Column, site: Column) -> DataFrame:
        raw = (
            F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "HEALTHY")
            .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "STARTING")
            .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "UNHEALTHY")
            .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "DRAINING")
            .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "healthy")
            .otherwise("OFFLINE")
        )
        cells = self.table("lineitem").select(
            tenant.alias("tenant_id"),
            pool.alias("pool_id"),
            word("10.1.0.", F.col("l_partkey")).alias("origin_address"),
            F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("origin_port"),
            site.alias("site_name"),
            raw.alias("raw_status"),
            F.floor("l_quantity").cast("int").alias("fails"),
            F.col("l_shipdate").alias("last_probe_at"),
        )
        key = ["tenant_id", "pool_id", "origin_address", "origin_port", "site_name"]
        newest = F.max(F.struct("last_probe_at", "raw_status", "fails")).alias("r")
        return (
            # dealt out and sorted by origin once, as most queries gather an origin's cells next
            cells.repartition(*ORIGIN)
            .groupBy(*ORIGIN, "site_name")
            .agg(newest)
            .select(
                *key,
                "r.raw_status",
                S.origin_status(F.col("r.raw_status")).alias("classified_status"),
                F.col("r.fails").alias("consecutive_failures"),
                "r.last_probe_at",
            )
        )

    @cached_property
    def origin_health(self) -> DataFrame:
        k = F.col("l_suppkey")
        return self._health(word("p", k), word("t", k % 3), word("site-", F.col("l_orderkey") % 25))

    @cached_property
    def order_health(self) -> DataFrame:
        """Many small pools: one per order."""
        k = F.col("l_orderkey")
        return self._health(word("o", k), word("t", k % 3), word("site-", F.col("l_suppkey") % 25))

    @cached_property
    def policies(self) -> DataFrame:
        c = F.col("c_custkey")
        ns = F.when(F.col("c_nationkey") == 0, "shared").otherwise(word("ns", c % 3))
        return self.table("customer").select(
            word("t", c % 3).alias("tenant_id"),
            nth(POLICY_TYPES, c % 4).alias("policy_type"),
            ns.alias("namespace"),
            word("pol-", c).alias("name"),
            (F.col("c_nationkey") == 0).alias("is_shared"),
        )

    @cached_property
    def attachments(self) -> DataFrame:
        """Links from orders: the customer's policy, or one that is unknown, to one of ten load balancers."""
        c, j = F.col("c_custkey"), F.col("o_orderkey") % 10
        orders = self.table("orders")
        ns = F.when(F.col("c_nationkey") == 0, "shared").otherwise(word("ns", c % 3))
        lost = (F.col("o_orderkey") % 17 == 0) | (c % 5 == 0)
        name = F.when(lost, word("ghost-", c)).otherwise(word("pol-", c))
        return (
            orders.join(self.table("customer"), F.col("o_custkey") == c)
            .select(
                word("t", c % 3).alias("tenant_id"),
                nth(POLICY_TYPES, c % 4).alias("policy_type"),
                ns.alias("policy_namespace"),
                name.alias("policy_name"),
                word("ns", j % 2).alias("lb_namespace"),
                word("lb-", j).alias("lb_name"),
            )
            .distinct()
        )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
