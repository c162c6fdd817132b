"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeline.session import scratch_path


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def keep(df: DataFrame, label: str, drop_shuffles: bool = False, compression: str = "snappy", apart: tuple[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    ``drop_shuffles`` frees the shuffle files of the job as soon as the table is
    written, for plans whose shuffles are large and not read again. ``apart`` is a
    column and how many values it has at most: each gets files of its own, so
    readers of one value read no others.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    settings = {FILE_CLEANUP: "true"} if drop_shuffles else {}
    write = df.write.option("compression", compression)
    if apart:
        # a task writes all values at once, so its rows need no sort
        write, settings[WRITERS] = write.partitionBy(apart[0]), str(apart[1])
    before = {k: spark.conf.get(k, d) for k, d in ((FILE_CLEANUP, "false"), (WRITERS, "0"))}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        write.parquet(path)
    finally:
        for k in settings:
            spark.conf.set(k, before[k])
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if apart else out
    out._kept_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that no frame still to be computed reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def rank_in_groups(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Gapless rank from 0 within the groups of ``keys``; no group is gathered in one task.

    Each group is cut into about sqrt(rows) cells by a hash of the ``order``
    columns. Ranks count within a cell and start after the rows of the cells
    before it, so neither a cell nor a group's list of cells exceeds about
    sqrt(rows). Equal rows get different ranks; which one gets which is the
    same thing, as they are equal in all ordered columns. Null keys form a group.
    """
    cells = max(1, isqrt(rows.count()))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(*[col(c) for c in order]), F.lit(cells)).cast("int"))
    part = [col(k) for k in keys]
    sizes = rows.groupBy(*part, "_cell").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(
        Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_cell").alias("_of"),
        F.coalesce(before, F.lit(0)).alias("_before"),
    )
    within = F.row_number().over(Window.partitionBy(*part, "_cell").orderBy(*[col(c) for c in order]))
    match = F.col("_cell") == F.col("_of")
    for i, k in enumerate(keys):
        match = match & col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumn("_within", within).join(sizes, match)
    return out.withColumn(name, (F.col("_before") + F.col("_within") - 1).cast("long")).drop(
        "_cell", "_of", "_before", "_within", *[f"_k{i}" for i in range(len(keys))]
    )


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes or characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Return freed memory, which Arrow's pool and the C library would hold for later, to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow; at its task's end the worker, which waits for other tasks beside the JVM, gives memory back."""

    def spared(batches):
        yield from run(batches)
        give_back()

    return spared


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_counts(texts: list[bytes]) -> np.ndarray:
    """How many words ``[^\\x20\\x09-\\x0D]+`` each text has."""
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    inside = ~_SPACE[np.frombuffer(b"".join(texts), np.uint8)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < len(inside)]
    starts[begin] = inside[begin]
    return np.diff(np.concatenate([[0], np.cumsum(starts)])[offsets])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: where they start and end, whose they are, their hashes.

    ``hash`` is a polynomial hash modulo 2^64 of the bytes with A-Z lowered,
    mixed; all words of all texts are hashed by array arithmetic. ``apart`` tells
    of each byte whether it separates words; with ``spans`` the sums that
    ``span_hash`` needs are held.
    """

    def __init__(self, texts: list[bytes], apart: np.ndarray = _SPACE, spans: bool = False):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        self.raw = raw
        inside = ~apart[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside
        first = inside & (~before[:-1] | edge[:-1])
        last = np.empty(n, bool)
        if n:
            last[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
            last[-1] = inside[-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWER[raw] * up[:n], out=sums[1:])
        if spans:
            self._sums, self._down = sums, down
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes, not mixed, of the bytes from ``lo`` to ``hi`` with A-Z lowered."""
        return (self._sums[hi] - self._sums[lo]) * self._down[lo]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k neighbouring words of one text, and the index of each one's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        return mix(h[at]), at
