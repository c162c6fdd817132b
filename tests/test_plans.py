"""Every registered query: its rows against DuckDB, and the shape of its plan."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from edgeline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    result = duck.execute(ORACLES[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in sorted(cols)]
    want = sorted(tuple(cell(r[i]) for i in at) for r in result.fetchall())
    assert got == want


def test_every_query_has_a_check():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_recent_events_read_few_columns_and_push_the_window(spark):
    plan = QUERIES["waf_topk_source_ip"](spark, SF)._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line and "user_id" in line][-1]
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in scan
    assert "WindowGroupLimit" in plan


def test_literal_windows_reach_the_scan(spark):
    from datetime import datetime, timedelta

    from edgeline.functions.timewin import within
    from edgeline.plans.views import Views

    v = Views(spark, SF)
    rows = within(v.waf_events, "event_time", datetime(2024, 1, 20), timedelta(hours=1))
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-19T23:00" in plan


def test_a_hot_group_is_split_for_every_n(spark):
    from pyspark.sql import functions as F

    from edgeline.functions.ranking import GROUP_SALT, top_per_group

    for n in (5, 5000):
        plan = top_per_group(spark.range(100).withColumn("g", F.lit(1)), ["g"], [F.asc("id")], n)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert GROUP_SALT in text


def test_an_append_reads_only_the_days_of_the_batch(spark, tmp_path):
    """One row of last year and many of today read two days, not the year between."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from edgeline.operators import tables

    schema = "event_time timestamp, id string, tenant_id string, lb_namespace string, lb_name string, landed_at timestamp"
    start = datetime(2024, 5, 1)
    data = [(start + timedelta(days=i), f"e{i}", "t", "n", "lb", start) for i in range(100)]
    path = f"{tmp_path}/events"
    tables.append_events(spark.createDataFrame(data, schema), path)
    again = [(t + timedelta(minutes=m), f"{k}-{m}" if m else k, *rest) for t, k, *rest in (data[0], data[99]) for m in range(20)]
    batch = spark.createDataFrame(again, schema)
    read = tables.on_days(spark.read.parquet(path), "event_time", tables.days_of(batch, "event_time"))
    assert read.count() == 2
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1][:200]
    files = {f.split("event_date=")[1][:10] for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files == {"2024-05-01", "2024-08-08"}
    assert "numPartitions" not in plan or "selectedPartitions: 2" in plan
    tables.append_events(batch, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 100 + 38 and stored.select("id").distinct().count() == 138
