"""Sharding by sampled splitters: shards of near equal bytes, ranges of a key.

Records are ordered by (hash of the text, id), so equal texts are neighbours
and share a shard unless a boundary must fall among them. A sample, drawn with a
chance in proportion to size, gives quantile boundaries of ``ranges`` key
ranges a shard. Exact sizes are then added up per range. Ranges at a shard
boundary would make one of its shards overfull and are subdivided: splitters are
sampled again within such ranges only, and the parts fill the shard before the
boundary, largest first, as far as they fit; the others go to the shard behind.
Shards differ from the mean by a small part's size. Counts per range give every
record a gapless slot in its shard without gathering a shard anywhere.

The sample and the range sizes are bounded by ``ranges`` and ``oversample``, not
by the data. A group of equal texts is cut by id, so a hot text is no hot range;
rows equal in text and id count as separate records, told apart by a number.

Cases: null text has no bytes, a record costs ``overhead`` bytes besides; null
ids come first; an empty table gives an empty result; other columns are kept by
``write_shards`` and ignored by ``assign``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeline.llm.common import col, keep

KEY = ["key", "tie"]


def _split_points(sample: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Boundaries that cut a size-weighted sample into ``parts`` of about equal weight."""
    got = sorted((r["key"], r["tie"]) for r in sample.select(*KEY).toLocalIterator())
    if not got:
        return []
    at = np.unique(np.linspace(0, len(got), parts + 1).astype(int)[1:-1])
    return sorted({got[i] for i in at})


def _boundary(lo: int, hi: int, share: float, shards: int, near: float) -> int | None:
    """The boundary behind shard k that bytes lo to hi touch or come ``near``."""
    k = int((lo + hi) / 2 / share + 0.5) - 1
    return k if 0 <= k < shards - 1 and lo < (k + 1) * share + near and hi > (k + 1) * share - near else None


def _draw(rows: DataFrame, total: int, target: int, salt: int) -> DataFrame:
    """Rows with a chance of size * target / total each; the draw is a hash, so a retry draws the same."""
    u = F.pmod(F.xxhash64("key", "tie", F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    return rows.where(u * max(total, 1) < F.col("size") * float(target))


def _range_of(rows: DataFrame, points: list[tuple[int, int]], name: str) -> DataFrame:
    """Number of boundaries at or below a row's key."""
    keys = np.array([p[0] for p in points], np.int64)
    ties = np.array([p[1] for p in points], np.int64)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, {name} int"
    at = [rows.columns.index(c) for c in KEY]

    def run(batches):
        for b in batches:
            key, tie = (b.column(i).to_numpy(zero_copy_only=False) for i in at)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for i in np.flatnonzero(lo < hi):
                lo[i] += np.searchsorted(ties[lo[i] : hi[i]], tie[i], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lo.astype(np.int32))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)


def assign(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    ranges: int = 128,
    oversample: int = 16,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every record; ``ranges`` are key ranges per shard."""
    text = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(col(text_col)).alias("key"),
    )
    rows = keep(rows, "keys")
    # rows equal in text and id are told apart by their place in the table just written
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    rows = rows.withColumn("tie", F.xxhash64("id", part, "_metadata.row_index"))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sample = shards * ranges * oversample
    points = _split_points(_draw(rows, total, sample, 1), shards * ranges)
    rows = _range_of(rows, points, "coarse")
    share = total / shards if total else 1.0

    near = share / 4
    cut, filled = {}, 0
    for r in rows.groupBy("coarse").agg(F.sum("size").alias("size")).orderBy("coarse").collect():
        if _boundary(filled, filled + r["size"], share, shards, near) is not None:
            cut[r["coarse"]] = r["size"]
        filled += r["size"]
    # second draw, within the ranges at a shard boundary alone
    inner = rows.where(F.col("coarse").isin(list(cut)))
    more = _split_points(_draw(inner, sum(cut.values()), sample, 2), shards * ranges)
    rows = keep(_range_of(rows.drop("coarse"), sorted({*points, *more}), "range"), "ranges")
    fine = rows.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("range").collect()
    held, filled = {}, 0
    edge: dict[int, list] = {}
    for r in fine:
        k = _boundary(filled, filled + r["size"], share, shards, near)
        if k is None:
            held[r["range"]] = min(shards - 1, int(filled / share))
        else:
            edge.setdefault(k, []).append(r)
        filled += r["size"]
    size = {r["range"]: r["size"] for r in fine}
    used = [0] * shards
    for r, k in held.items():
        used[k] += size[r]
    so_far = 0
    for k in range(shards):
        # what lies at the boundary behind shard k fills it, largest first, as far as it fits
        over = []
        for r in sorted(edge.get(k, []), key=lambda r: (-r["size"], r["range"])):
            if so_far + used[k] + r["size"] <= (k + 1) * share:
                held[r["range"]] = k
                used[k] += r["size"]
            else:
                over.append(r)
        if over and so_far + used[k] + over[-1]["size"] / 2 <= (k + 1) * share:
            held[over[-1]["range"]] = k
            used[k] += over.pop()["size"]
        for r in over:
            held[r["range"]] = k + 1
            used[k + 1] += r["size"]
        so_far += used[k]
    table, begin = [], [0] * shards
    for r in fine:
        k = held[r["range"]]
        table.append((r["range"], k, begin[k]))
        begin[k] += r["n"]
    spark = docs.sparkSession
    places = F.broadcast(spark.createDataFrame(table, "range int, shard int, begin long"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("key", "tie", "id", "size"))
    return (
        rows.withColumn("_within", within)
        .join(places, "range")
        .select("id", "size", "text_crc32", "shard", (F.col("begin") + F.col("_within") - 1).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", files: int = 1, **options) -> None:
    """Write every record with all its columns under ``path``/shard=N, ``files`` files a shard.

    Documents with a column named shard are written under shard_no=N.
    """
    into = "shard_no" if "shard" in docs.columns else "shard"
    places = assign(docs, shards, id_col, text_col, **options).select(
        F.col("id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.col("shard").alias(into)
    )
    # records equal in id and text are alike: they share the shard of the first
    places = places.groupBy("_id", "_crc", "_size").agg(F.min(into).alias(into))
    text = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    match = col(id_col).eqNullSafe(F.col("_id")) & (F.crc32(text) == F.col("_crc"))
    out = docs.join(places, match & (F.octet_length(text) + options.get("overhead", 8) == F.col("_size")))
    out = out.drop("_id", "_crc", "_size").withColumn("_file", F.pmod(F.xxhash64(col(id_col)), F.lit(files)))
    out.repartition(shards * files, into, "_file").drop("_file").write.partitionBy(into).parquet(path)
