import hashlib
import random

import duckdb
import numpy as np
import pytest

from edgeline.llm import centroids
from edgeline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def exact(rows, clusters, rounds, dims, scale):
    """(id, cluster, distance) by comparing everything, in whole numbers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in start[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = [a for a, _ in assign()]
        for k in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == k]
            if mine:
                c[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, a, d) for (i, _), (a, d) in zip(kept, assign(), strict=True)], c


def check(got, want, centres):
    by = lambda r: (r[0] is None, str(r[0]), r[1], r[2])
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got), key=by) == sorted(want, key=by)
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, a, d in want if a == r["cluster"])
        assert r["inertia"] == sum(d for *_, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("block", [4, 512])
def test_messy_vectors_against_brute_force(spark, block):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.2) for _ in range(6)]) for i in range(200)]
    rows += [(500 + i, rows[7][1]) for i in range(150)]  # one very common vector
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [float("nan")] * 6), (904, [float("-inf")] * 6), (905, [None] + [1.0] * 5)]
    rows += [(10, rows[10][1]), (11, rows[12][1]), (None, rows[13][1]), (None, rows[13][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "'k' as cluster", "2 as v")
    got = centroids.cluster(df.repartition(5), clusters=9, rounds=3, dims=6, block=block).collect()
    check(got, *exact(rows, 9, 3, 6, 256))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(12) for y in range(12))] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (3, 64):
        got = centroids.cluster(df, clusters=16, rounds=2, dims=2, scale=1, block=block).collect()
        check(got, *exact(rows, 16, 2, 2, 1))


def test_few_huge_and_no_vectors(spark):
    rows = [(0, [1.0, -2.5]), (1, [0.0, 3.0])]
    df = spark.createDataFrame([*rows, (2, [1e9, 0.0])], "vec_id long, embedding array<double>")
    check(centroids.cluster(df, dims=2).collect(), *exact(rows, 40, 5, 2, 256))
    out = centroids.cluster(df.limit(0), dims=2)
    assert out.count() == 0 and out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_the_test_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = QUERIES["op11_centroid_clustering"](spark, SF)
    want = con.execute(ORACLES["op11_centroid_clustering"])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
    keys = centroids.curve_keys(grid, bits)
    path = grid[np.lexsort(keys.T[::-1])]
    assert len(np.unique(keys, axis=0)) == len(grid)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_rule_out_centroids_and_lose_none():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 4))
    ruled_out = 0
    for _ in range(50):
        x = (rng.integers(-2000, 2000, 4) + rng.integers(-200, 200, (64, 4))).astype(np.int32)
        block = centroids.Block(x, x.min(0).astype(np.int64), x.max(0).astype(np.int64), x.sum(0))
        some = block.candidates(centres)
        d = ((x[:, None].astype(np.int64) - centres) ** 2).sum(2)
        assert set(d.argmin(1)) <= set(some)
        at, distance = block.nearest(centres)
        assert (at == d.argmin(1)).all() and (distance == d.min(1)).all()
        ruled_out += 40 - len(some)
    assert ruled_out > 50 * 30
