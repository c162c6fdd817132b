"""Top-n per group and most common value, safe for very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
GROUP_SALT = "__salt"


def _numbered(df: DataFrame, keys: list[str], order: list[Column], last: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).filter(F.col("__rn") <= last)


def top_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    n: int,
    *,
    offset: int = 0,
    rank: str | None = None,
) -> DataFrame:
    """Rows ``offset+1 .. offset+n`` of each group in the given order.

    Two passes for every n. The first ranks within (group, salt), where a map
    task belongs to one salt, and Spark drops what is beyond n before the shuffle
    where its own bound allows; so of a hot group only n rows per salt reach the
    task of the last pass, however many map tasks hold it.
    """
    last = offset + n
    salted = df.withColumn(GROUP_SALT, F.spark_partition_id() % SALTS)
    df = _numbered(salted, [*group, GROUP_SALT], order, last).drop("__rn", GROUP_SALT)
    out = _numbered(df, group, order, last)
    if offset:
        out = out.filter(F.col("__rn") > offset)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def commonest(value: Column, count: Column) -> Column:
    """Aggregate over (value, count) rows: highest count, smallest value on a tie."""
    return F.min(F.when(value.isNotNull(), F.struct((-count).alias("n"), value.alias("v"))))["v"]
