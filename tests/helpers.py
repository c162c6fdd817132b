"""Small helpers shared by the tests."""

import json
from datetime import datetime


def column(spark, values, function, kind="string"):
    """Apply a column function to a list of values, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def raw(spark, *payloads, tenant="t", ns="ns", lb="lb"):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    # each landed a minute after the one before
    return spark.createDataFrame(
        [(tenant, ns, lb, datetime(2024, 6, 1, 0, i), p) for i, p in enumerate(texts)],
        "tenant_id string, lb_namespace string, lb_name string, landed_at timestamp, payload string",
    )


def objects(spark, *payloads, tenant="t", ns="ns"):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    return spark.createDataFrame(
        [(tenant, ns, p) for p in texts], "tenant_id string, namespace string, payload string"
    )


def dt(text):
    return datetime.fromisoformat(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
