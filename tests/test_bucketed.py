"""Merges into bucketed tables: the same rows, and no shuffle of the target."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from edgeline.operators import merge, tables
from helpers import dt, rows

SCHEMA = "tenant_id string, namespace string, name string, last_seen_at timestamp, v int"
KEYS = merge.OBJECT_KEYS
SCOPE = ["tenant_id", "namespace"]
T0, T1 = dt("2024-05-01"), dt("2024-05-02")


def frame(spark, seed, n, at):
    """A tenant with a third of all rows, repeated keys and a null namespace."""
    r = random.Random(seed)
    return spark.createDataFrame(
        [("hot" if i % 3 == 0 else f"t{r.randrange(5)}", r.choice(["a", "b", None]), f"n{r.randrange(60)}", at, i) for i in range(n)], SCHEMA
    )


def shuffled_scans(df):
    """Scans of bucketed tables below an exchange of the plan."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth <= inside:
            inside = None
        if inside is None and "Exchange" in line:
            inside = depth
        if "Bucketed: true" in line or "spark_catalog" in line:
            found.append(inside is not None)
    return found


@pytest.fixture()
def no_broadcast(spark):
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(k, v)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture()
def table(spark, tmp_path):
    made = []

    def make(by):
        made.append(tables.BucketedTable(spark, f"objects_{uuid.uuid4().hex[:8]}", SCHEMA, by, 8))
        return made[-1]

    yield make
    for t in made:
        for v in t.versions():
            spark.sql(f"DROP TABLE {t.name}_v{v}")


def test_upserts_equal_the_plain_merge_and_move_the_batch_only(spark, table, no_broadcast):
    t = table(KEYS)
    plain = spark.createDataFrame([], SCHEMA)
    for seed, n in ((1, 300), (2, 80), (3, 80)):
        batch = frame(spark, seed, n, T1)
        plain = spark.createDataFrame(merge.upsert_overwrite(plain, batch, KEYS, F.col("v")).collect(), SCHEMA)
        t.upsert(batch, KEYS, F.col("v"))
        assert rows(t.read()) == rows(plain)
    assert len(t.versions()) == 2 and t.versions()[-1] == 2
    merged = merge.upsert_overwrite(t.read(), frame(spark, 4, 50, T1), KEYS, F.col("v"))
    assert shuffled_scans(merged) == [False]
    # rows stay in their buckets: one file for kept and one for fresh rows of each
    assert len(t.read().inputFiles()) <= 2 * 8


def test_reaping_scopes_moves_the_scopes_only(spark, table, no_broadcast):
    t = table(SCOPE)
    start = merge.one_per_key(frame(spark, 1, 200, T0).unionByName(frame(spark, 2, 60, T1)), KEYS, F.col("v"), newest=True)
    t.write(start)
    ok = spark.createDataFrame([("hot", "a"), ("t1", "b"), ("hot", "a")], "tenant_id string, namespace string")
    want = merge.reap_stale(start, T1, ok, SCOPE)
    assert shuffled_scans(merge.reap_stale(t.read(), T1, ok, SCOPE)) == [False]
    expected = rows(want)
    t.reap(T1, ok, SCOPE)
    assert rows(t.read().select(*start.columns)) == expected
    assert 0 < t.read().count() < start.count()


def test_an_empty_table_and_an_empty_batch(spark, table):
    t = table(KEYS)
    assert t.read().isEmpty()
    t.upsert(spark.createDataFrame([], SCHEMA), KEYS, F.col("v"))
    assert t.read().isEmpty()
    t.upsert(frame(spark, 1, 20, T0), KEYS, F.col("v"))
    before = rows(t.read())
    t.upsert(spark.createDataFrame([], SCHEMA), KEYS, F.col("v"))
    assert rows(t.read()) == before
