"""Readers for landed raw JSON and date-partitioned tables, batch and stream.

Event and metric records land as JSON lines
``{"tenant_id", "lb_namespace", "lb_name", "landed_at", "payload"}``;
configuration objects as ``{"tenant_id", "namespace", "landed_at", "payload"}``.
``payload`` is an object or a string holding JSON; the string column receives
the text of either. ``landed_at`` is the time of the pull that brought the
record: it decides which of two values of one key is the newer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline.functions import jsonvals as J

EVENT_RECORD = "tenant_id string, lb_namespace string, lb_name string, landed_at timestamp, payload string"
OBJECT_RECORD = "tenant_id string, namespace string, landed_at timestamp, payload string"


def read_records(spark: SparkSession, path: str, schema: str = EVENT_RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_records(
    spark: SparkSession, path: str, schema: str = EVENT_RECORD, files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def document(payload: Column) -> Column:
    """Payload -> VARIANT, also when the JSON text is itself wrapped in a JSON string."""
    once = J.parse(payload)
    return F.when(payload.startswith('"'), J.parse(J.text(once))).otherwise(once)


def partitions(time_col: str) -> dict[str, Column]:
    """Partition columns of a table by its time column: events by date, metric buckets by date and hour."""
    from edgeline.functions.timewin import DATE_COLUMNS

    day = {DATE_COLUMNS[time_col]: F.col(time_col).cast("date")}
    return day | ({"bucket_hour": F.hour(F.col(time_col))} if time_col == "bucket_time" else {})


def write_partitioned(df: DataFrame, path: str, time_col: str, mode: str = "append") -> None:
    """Write a table partitioned by ``partitions`` of its time column.

    Files are sorted by the columns most reads filter on, so parquet min/max
    statistics can skip row groups. Rows are rebalanced by partition: AQE joins
    small partitions' rows and splits a day that holds most of them.
    """
    parts = partitions(time_col)
    out = df.withColumns(parts)
    sort_cols = [c for c in (*parts, "tenant_id", "lb_name", "source_ip") if c in out.columns]
    (
        out.hint("rebalance", *[F.col(p) for p in parts])
        .sortWithinPartitions(*sort_cols)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )
