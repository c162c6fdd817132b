"""Writing merge results back to parquet tables.

Parquet has no row-level merge: a changed table is read, merged and written.
Rewritten partitions are checkpointed in the shared folder first, so the write
never overwrites files its own plan still reads, and only touched partitions
change. Current-state tables are written as a new version.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from edgeline.functions.timewin import DATE_COLUMNS, AsOf
from edgeline.operators import merge
from edgeline.session import cut_lineage
from edgeline.sources.landing import partitions, write_partitioned


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table, or an empty one shaped like ``like`` before its first write."""
    if exists(spark, path):
        return spark.read.schema(like.schema).parquet(path)
    return spark.createDataFrame([], like.schema)


class SnapshotTable:
    """A current-state table kept as complete versions ``path/v=<number>``.

    A new version is written beside the old one and counts once its ``_SUCCESS``
    marker exists, so a job that dies half-way leaves the old state readable.
    Writing version n from the newest version before n makes a repeated
    micro-batch produce the same rows again instead of applying them twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.path}/v=*/_SUCCESS")
        fs = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(pattern) or []
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)

    def read(self, before: int | None = None) -> DataFrame:
        usable = [v for v in self.versions() if before is None or v < before]
        if not usable:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={usable[-1]}")

    def write(self, df: DataFrame, version: int | None = None, keep: int = 3) -> int:
        done = self.versions()
        n = version if version is not None else (done[-1] + 1 if done else 0)
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for old in [v for v in done if v < n][: -keep or None]:
            gone = hadoop.Path(f"{self.path}/v={old}")
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
        return n


class BucketedTable:
    """A current-state table of the catalog cut into buckets by ``by``, kept as complete versions ``name_v<number>``.

    A merge joins it on the bucket columns, so only the batch is shuffled; give
    the columns of the key, or those of a scope if whole scopes are reaped. With
    as many buckets as shuffle partitions a batch moves once. Kept rows stay in
    their bucket and fresh rows are hashed into the same ones, so a version has
    about two files a bucket, however often it is merged.

    A version counts once it is in the catalog, which is after its files are
    written; the files of a job that died are overwritten by its repeat.
    """

    def __init__(self, spark: SparkSession, name: str, schema: str | StructType, by: list[str], buckets: int):
        self.spark, self.name, self.schema, self.by, self.buckets = spark, name, schema, by, buckets

    def versions(self) -> list[int]:
        found = self.spark.catalog.listTables(pattern=f"{self.name}_v*")
        ends = [t.name[len(self.name) + 2 :] for t in found if not t.isTemporary]
        return sorted(int(e) for e in ends if e.isdigit())

    def read(self) -> DataFrame:
        done = self.versions()
        return self.spark.table(f"{self.name}_v{done[-1]}") if done else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, *, aligned: bool = False, keep: int = 2) -> None:
        """Store a version; rows not ``aligned`` to the buckets are shuffled into them first."""
        done = self.versions()
        rows = df if aligned else df.repartition(self.buckets, *self.by)
        writer = rows.write.format("parquet").mode("overwrite").bucketBy(self.buckets, *self.by).sortBy(*self.by)
        writer.saveAsTable(f"{self.name}_v{done[-1] + 1 if done else 0}")
        for old in done[: -(keep - 1) or None]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{old}")

    def upsert(self, batch: DataFrame, keys: list[str], order: Column) -> None:
        self.write(merge.upsert_overwrite(self.read(), batch, keys, order), aligned=bool(self.versions()))

    def reap(self, sync_ts: AsOf, ok_scopes: DataFrame, scope: list[str], seen_col: str = "last_seen_at") -> None:
        self.write(merge.reap_stale(self.read(), sync_ts, ok_scopes, scope, seen_col), aligned=True)


def newest(table: DataFrame, time_col: str) -> Column:
    """Newest time of a table as a literal (one fetched value), so that it prunes a scan.

    Fetched as text: a clock time would pass through the driver's own time zone.
    """
    text = table.agg(F.max(time_col).cast("string")).first()[0]
    return F.lit(text).cast(table.schema[time_col].dataType)


def days_of(rows: DataFrame, *times: Column | str) -> list[date]:
    """The days that some times of the rows fall on: at most as many values as the calendar has days."""
    days = F.explode(F.array_distinct(F.array(*[(F.col(t) if isinstance(t, str) else t).cast("date") for t in times])))
    return sorted(r[0] for r in rows.select(days.alias("day")).where("day is not null").distinct().collect())


def on_days(table: DataFrame, time_col: str, days: list[date]) -> DataFrame:
    """Rows on the given days, which are literals: a table partitioned by day reads only these partitions.

    A day between two others is not read, so one row with an old or wrong clock
    costs a batch one more day and not all days since.
    """
    day = DATE_COLUMNS[time_col]
    column = F.col(day) if day in table.columns else F.col(time_col).cast("date")
    return table.filter(column.isin(days) if days else F.lit(False))


def _in_partitions_of(table: DataFrame, rows: DataFrame, time_col: str) -> DataFrame:
    """Rows of the table in the partitions that ``rows`` fall into."""
    parts = partitions(time_col)
    touched = rows.select(*[c.alias(n) for n, c in parts.items()]).distinct()
    return on_days(table, time_col, days_of(rows, time_col)).join(touched, list(parts), "left_semi")


def append_events(batch: DataFrame, path: str, order_col: str = "landed_at") -> None:
    """Append the events the table lacks; of equal keys in the batch the one landed first.

    Equal keys have equal times, so only the batch's days of the table are read.
    Nothing stored is rewritten, so the plan may read the table it appends to.
    """
    if batch.isEmpty():
        return
    dated = batch.withColumns(partitions("event_time"))
    target = on_days(read(batch.sparkSession, path, dated), "event_time", days_of(batch, "event_time"))
    fresh = merge.new_rows(target, batch, merge.EVENT_KEYS, F.col(order_col))
    write_partitioned(fresh, path, "event_time")


def upsert_buckets(batch: DataFrame, path: str, keys: list[str], order_col: str = "landed_at") -> None:
    """Replace metric buckets by the newest of the batch; only the hours it touches are rewritten."""
    if batch.isEmpty():
        return
    parts = partitions("bucket_time")
    target = read(batch.sparkSession, path, batch.withColumns(parts))
    target = _in_partitions_of(target, batch, "bucket_time").drop(*parts)
    merged = merge.upsert_overwrite(target, batch, keys, F.col(order_col))
    write_partitioned(cut_lineage(merged), path, "bucket_time", mode="overwrite")


def replace_buckets(fresh: DataFrame, path: str) -> None:
    """Store recomputed buckets: all rows of a bucket give way to the fresh ones.

    A bucket that was stored is never recomputed to nothing, as events are only
    added, so every partition that changes is written.
    """
    fresh = cut_lineage(fresh)
    if fresh.isEmpty():
        return
    parts = partitions("bucket_time")
    target = read(fresh.sparkSession, path, fresh.withColumns(parts))
    target = _in_partitions_of(target, fresh, "bucket_time").drop(*parts)
    kept = target.join(fresh.select("bucket_time").distinct(), "bucket_time", "left_anti")
    write_partitioned(cut_lineage(kept.select(*fresh.columns).unionByName(fresh)), path, "bucket_time", mode="overwrite")
