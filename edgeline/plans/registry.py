"""Named queries with the DuckDB SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeline.plans.ctes import with_views
from edgeline.plans.views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: list[str] | None = None):
    """Register a query under ``name``; without ``sql`` only its rows are checked."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = build
        if sql:
            ORACLES[name] = with_views(sql, uses or [])
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Comparable columns: zone-free times and arrays as joined text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(Views(spark, sf_dir)))

    run.__name__ = name
    return run


def load() -> None:
    """Import the modules that register queries."""
    from edgeline.plans import (  # noqa: F401
        alert_queries,
        config_queries,
        event_queries,
        ingest_queries,
        inventory_queries,
        live_queries,
        merge_queries,
        scalar_queries,
        stream_queries,
    )
