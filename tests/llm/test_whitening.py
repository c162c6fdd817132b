import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeline.llm import whitening
from edgeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def exact(rows, most=16):
    """Integers of the rows that take part, the distinct ones, their covariance's eigenvalues and vectors."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows])
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(0)
    c = (n * f - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, f, n, s, e[::-1][:most], v[:, ::-1][:, :most], np.trace(c.T @ c / n)


def check(got, rows, most=16):
    x, f, n, s, e, v, trace = exact(rows, most)
    z = (n * x - s) / n @ v / np.sqrt(e)
    assert len(got) == len(rows) * len(e)
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], {})[r["component"]] = r
    sign = None
    for i, (key, _) in enumerate(rows):
        mine = by_id[key]
        assert sorted(mine) == list(range(1, len(e) + 1))
        w = np.array([mine[k]["whitened"] for k in sorted(mine)])
        sign = np.sign(w * z[i]) if sign is None else sign
        np.testing.assert_allclose(w, z[i] * sign, rtol=1e-7, atol=1e-9)
        assert {r["n"] for r in mine.values()} == {n}
        assert {r["deviation"] for r in mine.values()} == {sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))}
        np.testing.assert_allclose([mine[k]["explained"] for k in sorted(mine)], e / trace, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in mine.values())


def test_the_test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op12_whitening"](spark, SF).withColumnRenamed("vec_id", "id").collect(), rows)


def test_messy_vectors(spark):
    rng = np.random.default_rng(6)
    made = rng.normal(size=(300, 5)) * [9, 5, 3, 2, 1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(made)]
    rows += [(400 + i, rows[3][1]) for i in range(500)]  # one very common vector counts once
    bad = [(900, None), (901, []), (902, [1.0] * 4), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [None] + [1.0] * 4), (906, [1e300] * 5)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("x", F.lit("k"))
    check(whitening.whiten(df.repartition(40)).collect(), rows)
    twice = whitening.whiten(df.union(df.where("vec_id < 5 or vec_id is null")).withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id"))))
    assert twice.where("id is null").count() == 5 and twice.where("id = 2").count() == 10


def test_no_variance_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], schema)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(5)], schema)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1}
    assert {round(r["explained"], 12) for r in got} == {1.0}


def test_deviations_beyond_a_long_are_null():
    c = whitening.centred(np.array([[1 << 40, 0], [1, 2]]), 1 << 30, [5, 7])
    assert c.tolist() == [[(1 << 70) - 5, -7], [(1 << 30) - 5, (1 << 31) - 7]]
    assert whitening.deviations(c) == [None, ((1 << 30) - 5) ** 2 + ((1 << 31) - 7) ** 2]


def triangle(x):
    x = x - x.mean(0)
    r = np.linalg.qr(x, mode="r")
    out = np.zeros((x.shape[1],) * 2)
    out[: len(r)] = r
    return x, out


RNG = np.random.default_rng(0)
CASES = {
    "normal": RNG.normal(size=(500, 24)),
    "fewer rows than dimensions": RNG.normal(size=(10, 24)),
    "constant and equal columns": np.concatenate([RNG.normal(size=(90, 4)), np.ones((90, 2)), np.tile(RNG.normal(size=(90, 1)), 2)], 1),
    "equal variances": np.concatenate([np.eye(8), -np.eye(8)]),
    "blocks": np.kron(np.eye(4), RNG.normal(size=(50, 5))),
    "graded": RNG.normal(size=(500, 6)) * 10.0 ** -np.arange(0, 12, 2),
    "one dimension": RNG.normal(size=(9, 1)),
}


@pytest.mark.parametrize("name", CASES)
def test_the_solver(name):
    x, r = triangle(CASES[name])
    values, axes = whitening.components(r, 24)
    want = np.linalg.svd(x, compute_uv=False)[: len(values)]
    assert len(values) == np.linalg.matrix_rank(x)
    np.testing.assert_allclose(values, want**2, rtol=1e-12)
    np.testing.assert_allclose(axes.T @ axes, np.eye(len(values)), atol=1e-9)
    assert np.abs(x.T @ (x @ axes) - axes * values).max() <= 1e-12 * values[0]


def test_very_close_pairs():
    b = np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1)
    values, axes = whitening.components(b, 20)
    np.testing.assert_allclose(axes.T @ axes, np.eye(len(values)), atol=1e-7)
    assert np.abs(b.T @ (b @ axes) - axes * values).max() <= 1e-7 * values[0]
