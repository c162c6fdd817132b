"""Centroid clustering over blocks of vectors in Hilbert order.

Vectors become integers (``floor(scale * x)``), so sums, means and distances are
exact. They are laid along a Hilbert curve over all dimensions and cut into
blocks of neighbours; a block keeps its box (smallest and largest value of every
dimension) and its sums: a zone map. In each round a block first takes the
centroid nearest to its box's middle; a centroid that is farther than this one
from every point of the box, by the bound of the difference of the two
distances over the box, is no candidate. Vectors are compared with the block's
candidates only, by exact arithmetic; a block with one candidate adds its stored
sums. The answer is that of comparing everything.

Blocks are stored once; a round reads them, adds up per task and sums the tasks'
parts by (cluster, dimension). The driver holds the centroids (their number times
the dimensions). The curve's keys carry a hash of the id, so that a vector that
very many rows share is dealt over several ranges.

Cases: vectors that are null, of another length, or hold null or non-finite
components take no part, nor do those with a component beyond 2^26 after scaling,
as their distances need not fit in a long; an empty cluster keeps its centroid;
fewer vectors than clusters give as many clusters as vectors; repeated rows and
equal ids each count, ties among starting vectors go by the vector, a null id
starts no cluster while others can; an empty table gives an empty result; an
inertia beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import col, keep

LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether every component is there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The vectors of a list column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of points given by ``bits`` bits a dimension; fixed-width bytes that sort along the curve.

    The curve is walked from the coarsest bit down: each level's turn of the
    axes is undone for the finer bits, then the levels' bits are Gray-decoded and
    interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        finer = bit - 1
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & finer)
            x[0] ^= np.where(turned, finer, swap)
            if i:
                x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)  # Gray code along the dimensions
    # the last dimension's set bits flip the finer bits of all
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flips
    planes = [(x[i] >> level) & 1 for level in range(bits - 1, -1, -1) for i in range(dims)]
    return np.packbits(np.stack(planes, 1).astype(np.uint8), axis=1)


@dataclass
class Block:
    """A run of vectors along the curve: ids by row, vectors, box and sums."""

    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, i: int) -> Block:
        dims = batch.column("dims")[i].as_py()
        x = np.frombuffer(batch.column("x")[i].as_buffer(), np.int32).reshape(-1, dims)
        box = np.frombuffer(batch.column("box")[i].as_buffer(), np.int64).reshape(3, dims)
        return Block(x, *box)

    def candidates(self, centres: np.ndarray) -> np.ndarray:
        """The centroids that some point of the box may be nearest to, by number."""
        middle = (self.low + self.high) / 2
        lead = int(((centres - middle) ** 2).sum(1).argmin())
        # |x - lead|^2 - |x - other|^2 = |lead|^2 - |other|^2 + 2 x (other - lead), at its largest over the box
        gap = centres - centres[lead]
        norms = (centres * centres).sum(1)
        most = norms[lead] - norms + 2 * np.maximum(gap * self.low, gap * self.high).sum(1)
        return np.flatnonzero((most > 0) | ((most == 0) & (np.arange(len(centres)) <= lead)))

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of every vector's nearest centroid, the smaller number on ties."""
        some = self.candidates(centres)
        x, c = self.x.astype(np.int64), centres[some]
        if len(some) == 1:
            at = np.zeros(len(x), np.int64)
        else:
            # whole numbers in doubles are exact while every sum stays under 2^53, and use the fast product
            size = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
            kind = float if 4 * x.shape[1] * size * size < 1 << 53 else np.int64
            a, b = x.astype(kind), c.astype(kind)
            at = ((b * b).sum(1) - 2 * (a @ b.T)).argmin(1)
        gap = x - c[at]
        return some[at], (gap * gap).sum(1)


def blocks_of(vectors: DataFrame, dims: int, bits: int, block: int) -> DataFrame:
    """(ids, x, box, dims) for runs of about ``block`` neighbours of (id, v) along the curve."""
    kind = vectors.schema["id"].dataType.simpleString()

    def spread(batches):
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), b.num_rows).astype(float)
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(s), pa.array(q)], names=["d", "n", "s", "q"])

    # where the curve's grid lies changes only which vectors share a block
    rows = vectors.select("v").mapInArrow(spread, "d long, n long, s double, q double").groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("d").collect()
    n = max(1, rows[0][1]) if rows else 1
    mean = np.array([r[2] for r in rows]) / n
    width = np.sqrt(np.maximum(np.array([r[3] for r in rows]) / n - mean**2, 1.0))
    low = mean - width * 1.5

    def place(batches):
        for b in batches:
            if b.num_rows:
                cells = np.clip((matrix(b.column(1), b.num_rows) - low) / (3 * width) * (1 << bits), 0, (1 << bits) - 1)
                keys = curve_keys(cells.astype(np.int64), bits)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(keys.shape[1]), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))])
                yield pa.RecordBatch.from_arrays([*b.columns, keys.cast(pa.binary())], names=["id", "v", "key"])

    placed = vectors.select("id", "v").mapInArrow(place, f"id {kind}, v array<long>, key binary").withColumn("salt", F.xxhash64("id", "v"))
    # a vector that very many rows share is cut by the salt
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(parts, "key", "salt").sortWithinPartitions("key", "salt")

    def pack(batches) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def flush(most: int) -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, held
            who, x = pa.concat_arrays(ids), np.concatenate(rows)
            while len(x) and len(x) >= most:
                part, mine = x[:block], who[:block]
                box = np.stack([part.min(0), part.max(0), part.sum(0)])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine), pa.array([part.astype(np.int32).tobytes()]), pa.array([box.tobytes()]), pa.array([dims], pa.int32())],
                    names=["ids", "x", "box", "dims"],
                )
                x, who = x[block:], who[block:]
            ids, rows, held = [who], [x], len(x)

        for b in batches:
            if b.num_rows:
                ids.append(b.column(0))
                rows.append(matrix(b.column(1), b.num_rows))
                held += b.num_rows
                if held >= 4 * block:
                    yield from flush(block)
        if held:
            yield from flush(1)

    return placed.select("id", "v").mapInArrow(pack, f"ids array<{kind}>, x binary, box binary, dims int")


def cluster(
    vectors: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = 2,
    block: int = 512,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    vector = col(vector_col)
    rows = vectors.where(finite(vector) & (F.size(vector) == dims)).select(col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double") * scale).alias("v"))
    rows = rows.where(~F.exists("v", lambda x: F.abs(x) > LARGEST)).withColumn("v", F.transform("v", lambda x: F.floor(x).cast("long")))
    rows = keep(rows, "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.withColumn("_first", first).orderBy(F.asc_nulls_last("_first"), "v").limit(clusters).collect()
    centres = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    if not len(centres):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = keep(blocks_of(rows, dims, bits, block), "blocks")

    def assigned(shared):
        def run(batches):
            c = shared.value
            count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
            for b in batches:
                for i in range(b.num_rows):
                    here = Block.of(b, i)
                    some = here.candidates(c)
                    if len(some) == 1:
                        count[some] += len(here.x)
                        total[some] += here.total
                        continue
                    at, _ = here.nearest(c)
                    count += np.bincount(at, minlength=len(c))
                    order = np.argsort(at, kind="stable")
                    edge = np.searchsorted(at[order], np.unique(at))
                    total[np.unique(at)] += np.add.reduceat(here.x[order].astype(np.int64), edge, axis=0)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(at, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(at))), pa.array(np.repeat(count[at], dims)), pa.array(total[at].ravel())],
                names=["cluster", "d", "n", "s"],
            )

        return run

    for _ in range(rounds):
        parts = blocks.select("x", "box", "dims").mapInArrow(assigned(spark.sparkContext.broadcast(centres)), "cluster int, d int, n long, s long")
        # one row for each cluster and dimension
        for r in parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            centres[r["cluster"], r["d"]] = r["s"] // r["n"]
    last = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            for i in range(b.num_rows):
                at, distance = Block.of(b, i).nearest(last.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), pa.array(at.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    out = keep(blocks.select("ids", "x", "box", "dims").mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("string").alias("s")).collect()}
    sums = {k: int(v) for k, v in sums.items()}

    def long(value: int) -> int | None:
        return value if value < 1 << 63 else None

    of = [(k, long(v), long(sum(sums.values())), digests[k]) for k, v in sorted(sums.items())]
    of = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
