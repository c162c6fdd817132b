"""Nearest neighbours by inner product: a forest of random-projection trees, one priority queue, exact reranking.

Trees are grown from a bounded sample: a node sends vectors to either side of
the median of their projections on the difference of two of its vectors, drawn
at random. Every vector is then indexed: it has one leaf in each tree. A query
walks all trees at once, best margin first, through one shared priority queue
until the leaves taken hold ``share`` of the sample each way or ``least``
candidates. The vectors of these leaves are scored exactly, in double precision.
Vectors of the sample are in the index too, so the (k + 1)-th best of those in a
query's leaves (it may be among them) bounds its result from below, and what
lies under the bound is not sent on.

For inner products, vectors are lengthened by one component that makes all
norms equal, and queries by zero; the longest norm is one number.

Vectors equal in all components are one entry with its smallest ids, one more
than ``k`` (a query may be among them), so copies cannot fill a leaf or a result.
A leaf of over ``block`` entries is cut into blocks, scored one by one.

Cases: vectors that are null, of norm zero or with null or non-finite
components take no part, nor do rows with a null id; vectors of another length
than the commonest raise an error; of rows equal in id the vectors count each;
with fewer candidates than k all are returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeline.llm.common import col, keep


class Tree:
    """Arrays of one tree: inner nodes have a direction, a threshold and two children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.direction, self.threshold, self.kids, self.leaf, self.held = [], [], [], [], []
        self._grow(sample, np.arange(len(sample)), leaf, rng)
        self.direction = np.array(self.direction).reshape(len(self.threshold), sample.shape[1])
        self.threshold, self.kids = np.array(self.threshold), np.array(self.kids).reshape(-1, 2)
        self.leaf, self.held = np.array(self.leaf), np.array(self.held)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        todo = [(rows, -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.threshold)
            if parent >= 0:
                self.kids[parent][side] = me
            self.threshold.append(0.0)
            self.direction.append(np.zeros(x.shape[1]))
            self.kids.append([-1, -1])
            self.held.append(len(rows))
            self.leaf.append(-1)
            for _ in range(4 if len(rows) > leaf else 0):
                a, b = x[rng.choice(rows, 2, replace=False)]
                way = a - b
                norm = np.linalg.norm(way)
                if norm == 0:
                    continue
                p = x[rows] @ (way / norm)
                cut = float(np.median(p))
                right = p > cut
                if 0.2 < right.mean() < 0.8:
                    self.direction[me], self.threshold[me] = way / norm, cut
                    todo += [(rows[~right], me, 0), (rows[right], me, 1)]
                    break
            else:
                self.leaf[me] = me

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(x), np.int64)
        while True:
            go = np.flatnonzero(self.leaf[at] < 0)
            if not len(go):
                return at
            node = at[go]
            right = np.einsum("ij,ij->i", x[go], self.direction[node]) > self.threshold[node]
            at[go] = self.kids[node, right.astype(int)]


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        self.top = float(np.sqrt((sample**2).sum(1).max())) if len(sample) else 1.0
        rng = np.random.default_rng(seed)
        x = self.lengthen(sample)
        self.trees = [Tree(x, leaf, rng) for _ in range(trees)]
        self.size, self.sample = len(sample), sample

    def lengthen(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))[:, None]], 1)

    def remember(self) -> None:
        """Note which vectors of the sample each leaf holds."""
        x = self.lengthen(self.sample)
        self.members = []
        for t in self.trees:
            at = t.place(x)
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(len(t.leaf) + 1))
            self.members.append((order, first))

    def bound(self, query: np.ndarray, leaves: list[tuple[int, int]], k: int) -> float:
        """A score that at least k + 1 vectors of these leaves reach."""
        rows = [order[first[v] : first[v + 1]] for t, v in leaves for order, first in (self.members[t],)]
        rows = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
        if len(rows) <= k:
            return -np.inf
        return float(np.partition(self.sample[rows] @ query, -k - 1)[-k - 1])

    def leaves(self, query: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until they hold ``wanted`` rows of the sample."""
        q = np.append(query / (np.linalg.norm(query) or 1.0) * self.top, 0.0)
        margins = [(t.direction @ q - t.threshold) for t in self.trees]
        queue = [(-np.inf, i, 0) for i in range(len(self.trees))]
        out, got = [], 0
        while queue and got < wanted:
            p, i, node = heapq.heappop(queue)
            t = self.trees[i]
            if t.leaf[node] >= 0:
                out.append((i, node))
                got += t.held[node]
                continue
            m = margins[i][node]
            heapq.heappush(queue, (max(p, -m), i, t.kids[node, 1]))
            heapq.heappush(queue, (max(p, m), i, t.kids[node, 0]))
        return out


def usable(vector: Column) -> Column:
    """Vectors that can be searched: there, finite in every component, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def build(entries: DataFrame, trees: int, leaf: int, sample: int, seed: int) -> Forest:
    """The forest over a bounded sample of (key, vec), drawn by hash of the vector."""
    n = entries.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    drawn = entries.where(F.pmod("key", F.lit(1 << 40)) < F.lit(int(share * (1 << 40)) + 1)).select("key", "vec").orderBy("key").limit(sample)
    rows = drawn.collect()
    x = np.array([r["vec"] for r in rows], float) if rows else np.zeros((0, 1))
    forest = Forest(x, trees, leaf, seed)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    forest.top = float(entries.agg(F.max(F.sqrt(norm))).first()[0] or 1.0)
    forest.remember()
    return forest


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 8,
    leaf: int = 128,
    sample: int = 16384,
    share: float = 1.5,
    block: int = 4096,
    seed: int = 29,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others found for each row of ``vectors`` that meets ``queries``."""
    spark = vectors.sparkSession
    own = vectors.where(usable(col(vector_col)) & col(id_col).isNotNull())
    own = own.select(col(id_col).alias("id"), col(vector_col).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked"))
    own = keep(own.withColumn("key", F.xxhash64("vec")), "vectors")
    if own.select(F.size("vec").alias("n")).distinct().limit(2).count() > 1:
        raise ValueError("vectors of different lengths")
    kind = own.schema["id"].dataType.simpleString()
    # the k + 1 smallest ids of every distinct vector; the limit is applied by map tasks too
    order = F.row_number().over(Window.partitionBy("key", "vec").orderBy("id"))
    entries = own.select("key", "vec", "id").withColumn("_n", order).where(F.col("_n") <= k + 1)
    entries = entries.groupBy("key", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = keep(entries.withColumn("id", F.col("ids")[0]), "entries")
    forest = build(entries, trees, leaf, sample, seed)
    shared = spark.sparkContext.broadcast(forest)
    wanted = max(int(share * forest.size), 4 * k)

    def index(batches):
        f = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = f.lengthen(b.column(1).flatten().to_numpy().astype(float).reshape(b.num_rows, -1))
            for i, t in enumerate(f.trees):
                n = b.num_rows
                none = pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(t.place(x).astype(np.int32)), b.column(0), b.column(1), none], names=["tree", "leaf", "id", "vec", "least"])

    def walk(batches):
        f = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().astype(float).reshape(b.num_rows, -1)
            for lo in range(0, len(x), 256):
                who, tree, node = [], [], []
                least = []
                for i in range(lo, min(lo + 256, len(x))):
                    found = f.leaves(x[i], wanted)
                    least += [f.bound(x[i], found, k)] * len(found)
                    for t, v in found:
                        who.append(i)
                        tree.append(t)
                        node.append(v)
                at = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(node, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(least, pa.float64())], names=["tree", "leaf", "id", "vec", "least"])

    shape = f"tree int, leaf int, id {kind}, vec {own.schema['vec'].dataType.simpleString()}, least double"
    placed = keep(entries.select("id", "vec").mapInArrow(index, shape), "leaves")
    asked = own.where("asked").select("id", "vec").mapInArrow(walk, shape)
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)  # at most as many rows as the forest has leaves
    placed = placed.join(sizes, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = asked.join(sizes, ["tree", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["tree", "leaf", "block", "asks", "id", "vec", "least"]
    both = placed.withColumn("asks", F.lit(False)).select(cols).union(asked.withColumn("asks", F.lit(True)).select(cols))
    both = both.repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", "asks")

    def rerank(batches):
        where, held_ids, held, ready = None, [], [], None
        best: list[pd.DataFrame] = []
        rows = 0

        def flush():
            got = pd.concat(best).drop_duplicates(["query", "found"])
            got = got.sort_values(["query", "score", "found"], ascending=[True, False, True]).groupby("query").head(k + 1)
            return pa.RecordBatch.from_arrays([pa.array(got["query"]), pa.array(got["found"]), pa.array(got["score"].astype(float))], names=["query", "found", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            ids = b.column(4).to_numpy(zero_copy_only=False)
            x = b.column(5).flatten().to_numpy().astype(float).reshape(b.num_rows, -1)
            least = b.column(6).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1, [len(place)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=False):
                here = tuple(place[lo, :3])
                if here != where:
                    where, held_ids, held, ready = here, [], [], None
                if not place[lo, 3]:
                    held_ids.append(ids[lo:hi])
                    held.append(x[lo:hi])
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = np.concatenate(held_ids), np.concatenate(held)
                for s in range(lo, hi, 512):
                    mine = slice(s, min(hi, s + 512))
                    found = _best(ids[mine], x[mine], least[mine], *ready, k + 1)
                    best.append(found)
                    rows += len(found)
            if rows > 400_000:
                yield flush()
                best, rows = [], 0
        if best:
            yield flush()

    found = both.mapInArrow(rerank, f"query {kind}, found {kind}, score double")
    found = found.groupBy("query", "found").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    found = found.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1)
    out = found.join(entries.select(F.col("id").alias("found"), "ids"), "found").withColumn("vec_id", F.explode("ids"))
    out = out.where("vec_id != query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def _best(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k largest inner products of every query from its bound on; sums run over the components in order, in double precision."""
    rough = q @ x.T
    floor = least
    if rough.shape[1] > k:
        floor = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k])
    slack = 1e-9 * (1 + np.abs(rough).max())
    a, b = np.nonzero(rough >= floor[:, None] - slack)
    score = np.zeros(len(a))
    for j in range(q.shape[1]):
        score += q[a, j] * x[b, j]
    return pd.DataFrame({"query": q_ids[a], "found": ids[b], "score": score})
