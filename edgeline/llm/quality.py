"""Quality scores by a regularised quadratic discriminant over document statistics.

A document's statistics are shares and means over its whole text (``NAMES``),
transformed to be near normal. Each class has a mean and a covariance, shrunk
towards the pooled covariance by ``shrink`` and towards its own mean variance by
``ridge``. The score is the probability of class 1 from the difference of the two
Gaussian log-densities (Mahalanobis distance by a Cholesky factor that is
computed once, and its log-determinant) and the classes' shares.

The fit needs class counts, sums and products of the statistics only; they are
added up over all labelled rows, so the driver holds a few hundred numbers.

Cases: null text is empty, and an empty text has its own row of statistics
(all zero counts) and gets a score; rows with several labels count with each,
null labels count nowhere; without rows of both classes every score is the share
of class 1 (0.5 without any); an empty table gives an empty result; other
columns are ignored by ``score`` and kept by ``drop_rejected``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import Words, col, keep, lean, slices, utf8

NAMES = [
    "words", "word_length", "upper", "digits", "symbols", "marks", "loud", "bars", "breaks",
    "short_words", "long_words", "distinct", "repeated_lines", "stops",
]
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 symbol, 5 mark, 6 !, 7 |, 8 line break, 9 blank, 10 beyond ASCII
for _chars, _kind in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b".,;:?'\"()-", 5), (b"!", 6), (b"|", 7), (b"\n", 8), (b" \t\r", 9), (range(128, 256), 10)):
    _CLASS[list(_chars)] = _kind
_CLASS[(_CLASS == 0) & (np.arange(256) > 32)] = 4


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for lo, hi in slices(texts, 1 << 18):
        out[lo:hi] = _statistics(texts[lo:hi])
    return out


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    w = Words(texts)
    size = np.diff(w.offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    count = np.bincount(doc * 11 + kinds, minlength=n * 11).reshape(n, 11).astype(float)
    letters = count[:, 1] + count[:, 2] + count[:, 10]
    solid = size - count[:, 8] - count[:, 9]
    length = w.end - w.start
    words = w.counts.astype(float)

    def share(part, whole, prior=20.0):
        # a short text says little: its shares start from one in fifty
        return np.log((part + prior * 0.02) / (whole + prior))

    total = np.bincount(w.doc, length, n)
    short = np.bincount(w.doc, length <= 3, n)
    long_ = np.bincount(w.doc, length >= 12, n)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[fresh], minlength=n)
    lines, again = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        rows = [x for x in t.split(b"\n") if len(x) > 12]
        lines[i] = len(rows)
        again[i] = len(rows) - len(set(rows))
    return np.stack([
        np.log1p(words), np.log1p(total / np.maximum(words, 1)), share(count[:, 1], letters), share(count[:, 3], solid),
        share(count[:, 4], solid), share(count[:, 5], solid), share(count[:, 6], solid), share(count[:, 7], solid),
        share(count[:, 8], size), share(short, words), share(long_, words), distinct / np.maximum(words, 1) ** 0.85,
        share(again, lines), share(np.bincount(doc, np.frombuffer(b"".join(texts), np.uint8) == 46, n), words),
    ], 1)


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log-densities' constants; ``share`` is that of class 1."""

    share: float
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    level: np.ndarray | None = None

    @staticmethod
    def fit(count: np.ndarray, total: np.ndarray, product: np.ndarray, shrink: float, ridge: float) -> Discriminant:
        """From counts (2), sums (2, p) and sums of products (2, p, p) of the classes."""
        if not count.all():
            return Discriminant(float(count[1] / count.sum()) if count.sum() else 0.5)
        mean = total / count[:, None]
        scatter = product - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / max(1.0, count.sum() - 2)
        factor, level = [], []
        for k in range(2):
            cov = (1 - shrink) * scatter[k] / max(1.0, count[k] - 1) + shrink * pooled
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-9) * np.eye(len(cov))
            low = np.linalg.cholesky(cov)
            factor.append(np.linalg.inv(low))
            level.append(np.log(count[k] / count.sum()) - np.log(np.diag(low)).sum())
        return Discriminant(float(count[1] / count.sum()), mean, np.array(factor), np.array(level))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.mean is None:
            return np.full(len(x), self.share)
        log = [self.level[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in range(2)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(buckets))


def score(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_fold: int = 0,
    shrink: float = 0.5,
    ridge: float = 0.01,
) -> DataFrame:
    """(id, text_key, held_out, score) of every row; rows with crc32(id) mod folds = held_fold teach nothing."""

    def run(batches):
        for b in batches:
            x = statistics(utf8(b.column(2)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["id", "text_key", "x"])

    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("text_key"), col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = keep(rows.mapInArrow(lean(run), f"id {kind}, text_key long, x array<double>"), "statistics")
    rows = rows.withColumn("held_out", F.coalesce(bucket(F.col("id"), folds) == held_fold, F.lit(False)))
    taught = labels.select(col(id_col).alias("_id"), col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    taught = rows.where(~F.col("held_out")).join(taught, F.col("id") == F.col("_id")).select("x", "y")

    def add_up(batches):
        p = len(NAMES)
        sums = np.zeros((2, 1 + p + p * p))
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False))
                y = b.column(1).to_numpy(zero_copy_only=False)
                for k in range(2):
                    z = x[y == k]
                    sums[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        at = np.tile(np.arange(sums.shape[1]), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], sums.shape[1])), pa.array(at), pa.array(sums.ravel())], names=["y", "at", "v"])

    parts = taught.mapInArrow(add_up, "y long, at long, v double").groupBy("y", "at").agg(F.array_sort(F.collect_list("v")).alias("v"))
    p = len(NAMES)
    sums = np.zeros((2, 1 + p + p * p))
    # added in sorted order, so that reruns agree to the last bit
    for r in parts.select("y", "at", F.expr("aggregate(v, 0D, (a, b) -> a + b)").alias("v")).collect():
        sums[r["y"], r["at"]] = r["v"]
    model = Discriminant.fit(sums[:, 0], sums[:, 1 : p + 1], sums[:, p + 1 :].reshape(2, p, p), shrink, ridge)

    def judge(batches):
        for b in batches:
            x = b.column(3).flatten().to_numpy().reshape(-1, p)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(model.score(x))], names=["id", "text_key", "held_out", "score"])

    return rows.select("id", "text_key", "held_out", "x").mapInArrow(judge, f"id {kind}, text_key long, held_out boolean, score double")


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with a score of at least ``threshold``, all columns. Rows equal in id and text share a score."""
    scores = score(docs, labels, id_col=id_col, text_col=text_col, **options)
    out = scores.where(F.col("score") < threshold).select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = docs.withColumn("_text_key", F.xxhash64(col(text_col)))
    match = col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    return rows.join(out, match, "left_anti").drop("_text_key")
