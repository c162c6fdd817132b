"""Pages by cursor against the whole order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from edgeline.functions import paging
from edgeline.functions.paging import Key
from edgeline.operators import alerts, api

ROW = "tenant_id string, score bigint, seen timestamp, name string"
ORDERS = [
    [Key("score", True), Key("seen"), Key("name")],
    [Key("seen", True), Key("name")],
    [Key("twice", True), Key("seen"), Key("name", True)],
    [Key("name")],
]


@pytest.fixture(scope="module")
def data(spark):
    """Many ties and nulls in every key but the last; times to the microsecond."""
    r = random.Random(3)
    some = lambda x: None if r.random() < 0.3 else x
    t0 = datetime(2024, 3, 31, 1, 59, 59, 999_999)
    return spark.createDataFrame(
        [
            (f"t{i % 2}", some(r.randrange(3)), some(t0 + timedelta(microseconds=r.randrange(4))), f"n{i:02}" if i > 1 else None)
            for i in range(60)
        ],
        ROW,
    ).cache()


@pytest.mark.parametrize("n", range(len(ORDERS)))
def test_all_pages_make_the_whole_order(data, n):
    keys = list(ORDERS[n])
    if keys[0].name == "twice":
        keys[0] = Key("twice", True, F.col("score") * 2)
    for tenant in ("t0", "t1"):
        want = data.filter(F.col("tenant_id") == tenant).orderBy(*paging.sort(keys)).collect()
        got, at = [], {"tenant_id": tenant}
        page = paging.page(data.filter(F.col("tenant_id") == tenant), ["tenant_id"], keys, 7)
        while (at := paging.cursor(page, keys, tenant_id=tenant)) is not None:
            got += page.orderBy(*paging.sort(keys)).collect()
            assert all(v is None or isinstance(v, str) for v in at.values())
            page = paging.page(data, ["tenant_id"], keys, 7, at=at)
        assert got == want


def test_pages_of_all_tenants_at_once(data):
    keys = ORDERS[0]
    got, page = [], paging.page(data, ["tenant_id"], keys, 11)
    for _ in range(4):
        got += page.collect()
        page = paging.page(data, ["tenant_id"], keys, 11, at=paging.cursors(page, ["tenant_id"], keys))
    assert page.isEmpty()
    assert sorted(map(str, got)) == sorted(map(str, data.collect()))


def test_rows_added_before_the_cursor_move_nothing(data, spark):
    keys = [Key("name")]
    first = paging.page(data, ["tenant_id"], keys, 5)
    at = paging.cursor(first, keys, tenant_id="t0")
    want = paging.page(data, ["tenant_id"], keys, 5, at=at).collect()
    more = data.union(spark.createDataFrame([("t0", 1, None, "a0"), ("t0", 1, None, "a1")], ROW))
    assert paging.page(more, ["tenant_id"], keys, 5, at=at).collect() == want


def test_the_bound_reaches_the_scan(spark, folder):
    path = folder + "/alerts"
    spark.range(100).select(
        F.lit("t").alias("tenant_id"), F.lit("open").alias("status"), F.lit("info").alias("severity"), F.lit("r").alias("rule_id"),
        F.col("id").cast("string").alias("dedupe_key"), F.timestamp_seconds(F.col("id") * 3600).alias("last_seen_at"),
    ).write.parquet(path)
    table = spark.read.parquet(path)
    at = paging.cursor(alerts.alert_list(table, limit=40), alerts.ALERT_KEYS, tenant_id="t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    page = alerts.alert_list(table, limit=5, after=at)
    assert [r["dedupe_key"] for r in page.collect()] == ["59", "58", "57", "56", "55"]
    plan = page._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("], ReadSchema")[0]
    assert "LessThanOrEqual(last_seen_at" in pushed and "EqualTo(tenant_id,t)" in pushed
    assert paging.cursor(alerts.alert_list(table.limit(0)), alerts.ALERT_KEYS, tenant_id="t") is None


def test_endpoint_keys_are_unique_names():
    for sort in ("volume", "last_seen", "method", "path"):
        names = [k.name for k in api.endpoint_keys(sort)]
        assert len(names) == len(set(names)) and {"endpoint_path", "method", "lb_namespace", "lb_name"} <= set(names)
