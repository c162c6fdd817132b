"""Age limits of tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline import settings
from edgeline.functions.timewin import DATE_COLUMNS, AsOf, moment, span


def retention(df: DataFrame, time_col: str, days: int, as_of: AsOf) -> DataFrame:
    """Rows young enough to keep; prunes date partitions where the table has them."""
    cutoff = moment(df, time_col, as_of) - span(timedelta(days=days))
    cond = F.col(time_col) >= cutoff
    day = DATE_COLUMNS.get(time_col)
    if day in df.columns:
        cond &= F.col(day) >= cutoff.cast("date")
    return df.filter(cond)


def resolved_alert_retention(
    alerts: DataFrame, as_of: AsOf, days: int = settings.ALERT_RETENTION_DAYS
) -> DataFrame:
    """Old resolved alerts go; open and acknowledged ones never expire."""
    cutoff = moment(alerts, "resolved_at", as_of) - span(timedelta(days=days))
    gone = (F.col("status") == "resolved") & (F.col("resolved_at") < cutoff)
    return alerts.filter(~F.coalesce(gone, F.lit(False)))


def audit_retention(
    audit: DataFrame, as_of: AsOf, days: int = settings.AUDIT_RETENTION_DAYS
) -> DataFrame:
    cutoff = moment(audit, "created_at", as_of) - span(timedelta(days=max(int(days), 1)))
    return audit.filter(~F.coalesce(F.col("created_at") < cutoff, F.lit(False)))


def drop_old_partitions(spark: SparkSession, path: str, day_col: str, before: date) -> list[str]:
    """Delete whole day folders older than ``before``; reads filter the boundary day."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.globStatus(hadoop.Path(f"{path}/{day_col}=*")) or []:
        day = status.getPath().getName().split("=", 1)[1]
        if day < before.isoformat():
            fs.delete(status.getPath(), True)
            gone.append(day)
    return sorted(gone)
