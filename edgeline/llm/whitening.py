"""Whitening of embeddings by singular values of the centred rows, without forming their covariance.

Entries become integers (``floor(scale * c) + shift``). The fit list holds every
distinct vector once; n is its length and S its sums, both exact. Rows are centred
exactly, (n x - S) / n. Each task reduces its centred rows to a triangular factor
by QR, factors are stacked and reduced again in a tree, and one d x d triangle R
reaches the driver. Householder reflections make R bidiagonal, the dqds algorithm
(differential quotient-difference with shifts) finds its singular values to high
relative accuracy, and a twisted factorisation for each gives its right vector.
Component k projects a centred row on its vector and divides by the square root
of its variance, sigma^2 / n.

Cases: vectors that are null, empty, or hold null or non-finite entries or entries
beyond 2^45 after scaling are dropped, as are those of another length than most
(of equally common lengths the smaller stays); repeated rows count once in the fit
and are all returned, with the ids they have, null too; equal variances share a
space and any orthonormal vectors of it are returned; components without variance
(to double precision) are left out, so one distinct vector gives no rows; a
deviation beyond a long is null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.llm.centroids import finite, matrix
from edgeline.llm.common import col, keep

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny / EPS


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V^T, by Householder reflections."""
    a = r.astype(float).copy()
    d = a.shape[1]
    v = np.eye(d)

    def mirror(x: np.ndarray) -> tuple[np.ndarray, float]:
        """(w, beta) so that x - beta w (w.x) is a multiple of the first unit vector."""
        size = np.abs(x).max(initial=0.0)
        if not size or not np.abs(x[1:]).max(initial=0.0):
            return x * 0, 0.0
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w, 2.0 / float(w @ w)

    for k in range(d):
        w, beta = mirror(a[k:, k].copy())
        a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w, beta = mirror(a[k, k + 1 :].copy())
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds."""
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not size:
        return np.zeros(len(diagonal))
    q = [float(x) for x in (diagonal / size) ** 2]
    e = [float(x) for x in (above / size) ** 2]
    out: list[float] = []
    moved = 0.0  # all shifts so far
    while q:
        n = len(q)
        if n == 1:
            out.append(moved + q[0])
            break
        if e[-1] <= EPS * EPS * (moved + q[-1]) or e[-1] <= TINY:
            out.append(moved + q.pop())
            e.pop()
            continue
        # the smaller eigenvalue of the last two rows is close to the smallest of all, from either side
        x, y, c = q[-2], q[-1], e[-1]
        total = x + y + c
        shift = 2 * x * y / (total + max(total * total - 4 * x * y, 0.0) ** 0.5) if total else 0.0
        for trial in range(4):
            new = _dqds(q, e, shift if trial < 3 else 0.0)
            if new:
                break
            shift *= 0.9 if not trial else 0.3
        moved += shift if trial < 3 else 0.0
        q, e = new
    return np.sort(np.array(out))[::-1] * size * size


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One step; none if the shift exceeds the smallest eigenvalue."""
    new_q, new_e = [], []
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        if top <= TINY:
            top = TINY
        ratio = q[k + 1] / top
        new_q.append(top)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of B^T B - value: multipliers from the top, from the bottom, and the twist at every place."""
    n = len(diagonal)
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = diagonal[k] ** 2 + s[k] or -EPS * max(value, TINY)
        down[k] = diagonal[k] * above[k] / pivot
        s[k + 1] = above[k] ** 2 * (s[k] / pivot) - value
    p[n - 1] = diagonal[n - 1] ** 2 - value
    for k in range(n - 2, -1, -1):
        pivot = above[k] ** 2 + p[k + 1] or -EPS * max(value, TINY)
        up[k] = diagonal[k] * above[k] / pivot
        p[k] = diagonal[k] ** 2 * (p[k + 1] / pivot) - value
    return down, up, s + p + value


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors, one column for each of the falling ``values`` (squares)."""
    n = len(diagonal)
    out = np.zeros((n, len(values)))
    for j, value in enumerate(values):
        # vectors of nearly equal values are made orthogonal to each other
        close = [i for i in range(j) if values[i] - value <= 1e-5 * value]
        down, up, twist = twisted(diagonal, above, value)
        best, least = None, np.inf
        for at in np.argsort(np.abs(twist), kind="stable")[: 8 * len(close) + 2]:
            z = np.zeros(n)
            z[at] = 1.0
            for k in range(at - 1, -1, -1):
                z[k] = -down[k] * z[k + 1]
            for k in range(at, n - 1):
                z[k + 1] = -up[k] * z[k]
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= out[:, close] @ (out[:, close].T @ z)
                z /= np.linalg.norm(z) or 1.0
            b = diagonal * z
            b[:-1] += above * z[1:]
            rest = diagonal * b - value * z
            rest[1:] += above * b[:-1]
            wrong = np.linalg.norm(rest) if z.any() else np.inf
            if best is None or wrong < least:
                best, least = z, wrong
            if wrong <= 64 * EPS * values[0]:
                break
        if least > 1e-9 * values[0]:
            # every twist gave the same vector of a close group: inverse iteration beside the group's others
            b = np.diag(diagonal) + np.diag(above, 1)
            best = np.cos(np.arange(n) * (j + 1.0))
            for _ in range(4):
                best = np.linalg.solve(b.T @ b - value * (1 + 8 * EPS) * np.eye(n), best)
                best -= out[:, close] @ (out[:, close].T @ best)
                best /= np.linalg.norm(best)
            best -= out[:, close] @ (out[:, close].T @ best)
            best /= np.linalg.norm(best)
        out[:, j] = best
    return out


def components(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right vectors) of a triangle, the largest ``most`` that are not zero to double precision."""
    diagonal, above, v = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    values = values[: max(0, min(most, int((values > (len(values) * EPS) ** 2 * values[:1].sum()).sum())))]
    vectors = v @ right_vectors(diagonal, above, values)
    return values, vectors


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, exact: whole numbers of 64 bits, or of any size where these might not do."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, s), default=0))
    kind = np.int64 if most < 1 << 62 else object
    return x.astype(kind) * n - np.array(s, kind)


def deviations(c: np.ndarray) -> list[int | None]:
    """Sums of squares of every row; null beyond a long."""
    most = int(abs(c).max(initial=0))
    if c.shape[1] * most * most >= 1 << 63:
        c = c.astype(object)
    return [v if v < 1 << 63 else None for v in map(int, (c * c).sum(1))]


def fit(distinct: DataFrame, n: int, s: list[int], fan: int = 32) -> np.ndarray:
    """The triangle of the centred rows of ``distinct``."""
    d = len(s)

    def stack(batches, at: int) -> np.ndarray:
        r = np.zeros((0, d))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(at), b.num_rows)
                for lo in range(0, len(x), 4096):
                    r = np.linalg.qr(np.concatenate([r, centred(x[lo : lo + 4096], n, s).astype(float) / n]), mode="r")
        return r

    def first(batches):
        from pyspark import TaskContext

        r = stack(batches, 0)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()])], names=["part", "r"])

    def again(batches) -> Iterator[pa.RecordBatch]:
        part, r = None, np.zeros((0, d))
        for b in batches:
            for g, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if part is not None and g != part:
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([r.tobytes()])], names=["part", "r"])
                    r = r[:0]
                part = g
                r = np.linalg.qr(np.concatenate([r, np.frombuffer(raw.as_buffer()).reshape(-1, d)]), mode="r")
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([r.tobytes()])], names=["part", "r"])

    parts = keep(distinct.select("x").mapInArrow(first, "part long, r binary"), "triangles")
    while parts.count() > 1:
        groups = parts.select(F.floor(F.col("part") / fan).alias("g"), "part", "r")
        groups = groups.repartition("g").sortWithinPartitions("g", "part")
        parts = keep(groups.mapInArrow(again, "part long, r binary"), "triangles")
    rows = parts.collect()
    r = np.zeros((d, d))
    if rows:
        got = np.frombuffer(rows[0]["r"]).reshape(-1, d)
        r[: len(got)] = got
    return r


def whiten(
    vectors: DataFrame,
    most: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every vector that takes part."""
    spark = vectors.sparkSession
    vector = col(vector_col)
    rows = vectors.where(finite(vector) & (F.size(vector) > 0)).select(col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double") * scale).alias("x"))
    rows = rows.where(~F.exists("x", lambda x: F.abs(x) > float(1 << 45)))
    rows = keep(rows.withColumn("x", F.transform("x", lambda x: F.floor(x).cast("long") + shift)), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return spark.createDataFrame([], shape)
    d = usual["d"]
    rows = rows.where(F.size("x") == d)
    distinct = keep(rows.select("x").distinct(), "distinct")

    def add_up(batches):
        n, s = 0, [0] * d
        for b in batches:
            if b.num_rows:
                n += b.num_rows
                s = [a + int(t) for a, t in zip(s, matrix(b.column(0), b.num_rows).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], names=["d", "n", "s"])

    sums = distinct.mapInArrow(add_up, "d long, n long, s decimal(38,0)").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d").collect()
    n, s = int(sums[0]["n"]), [int(r["s"]) for r in sums]
    r = fit(distinct, n, s)
    values, axes = components(r, most)
    trace = float((r * r).sum()) / n
    m = len(values)
    model = spark.sparkContext.broadcast((axes / np.sqrt(values / n), values / n / trace if trace else values))

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = centred(x, n, s)
        return c, c.astype(float) / n @ model.value[0]

    def moments(batches):
        total = np.zeros(m + m * m)
        for b in batches:
            if b.num_rows:
                _, z = projected(matrix(b.column(0), b.num_rows))
                total += np.concatenate([z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    error = 0.0
    if m:
        total = np.zeros(m + m * m)
        for row in distinct.mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            total[row["at"]] = row["v"] / n
        # the rows are centred already; what is left of their mean is rounding
        error = float(np.abs(total[m:].reshape(m, m) - np.outer(total[:m], total[:m]) - np.eye(m)).max())

    def apply(batches):
        share = model.value[1]
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                c, z = projected(matrix(part.column(1), part.num_rows))
                k = len(z)
                at = pa.array(np.repeat(np.arange(k), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n)),
                        pa.array(deviations(c), pa.int64()).take(at), pa.array(z.ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * m, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("id", "x").mapInArrow(apply, shape)
