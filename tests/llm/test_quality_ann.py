import random
import zlib

import numpy as np
import pytest
from fixtures_path import fixtures as fx
from pyspark.sql import functions as F

from edgeline.llm import ann, quality
from edgeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = QUERIES["op8_quality_classifier"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = rows.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.98
    good = np.array([r["score"] for r in held if r["quality"] == 1])
    bad = np.array([r["score"] for r in held if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.99


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.bucket(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["id"]: r["score"] for r in quality.score(docs, labels).collect()}
    b = {r["id"]: r["score"] for r in quality.score(docs, flipped).collect()}
    assert a == b


def test_discriminant_against_densities():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], [200, 300])
    count = np.array([200.0, 300.0])
    total = np.array([x[y == k].sum(0) for k in range(2)])
    product = np.array([x[y == k].T @ x[y == k] for k in range(2)])
    model = quality.Discriminant.fit(count, total, product, 0.3, 0.1)
    covs = [np.cov(x[y == k].T) for k in range(2)]
    pooled = (199 * covs[0] + 299 * covs[1]) / 498
    log = []
    for k in range(2):
        c = 0.7 * covs[k] + 0.3 * pooled
        c = 0.9 * c + 0.1 * np.trace(c) / 3 * np.eye(3)
        d = x - x[y == k].mean(0)
        log.append(np.log(count[k] / 500) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(log[0] - log[1])))


@pytest.mark.parametrize("clash", [False, True])
def test_scores_of_messy_rows(spark, clash):
    docs = fx.messy_rows()
    df = fx.frame(spark, docs, clash)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(df, labels).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r["score"] <= 1 for r in rows)
    out = quality.drop_rejected(df, labels)
    assert out.columns == df.columns
    assert out.count() == sum(r["score"] >= 0.3 for r in rows)


def test_one_class_and_no_rows(spark):
    df = fx.frame(spark, fx.messy_rows())
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(df, labels).collect()} == {1.0}
    assert {r["score"] for r in quality.score(df, labels.limit(0)).collect()} == {0.5}
    assert quality.score(fx.empty(spark), labels).count() == 0


def exact(rows, asked, k):
    """id -> [(vec_id, score)] by all inner products, components added in order."""
    out = {}
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    for i in np.flatnonzero([asked(r[0]) for r in rows]):
        s = np.zeros(len(ids))
        for j in range(x.shape[1]):
            s += x[i, j] * x[:, j]
        order = [o for o in np.lexsort((ids, -s)) if ids[o] != ids[i]]
        out[int(ids[i])] = [(int(ids[o]), float(s[o])) for o in order[:k]]
    return out


def recall(got, want):
    hit = total = 0
    for q, rows in want.items():
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        truth = dict(rows)
        hit += len(mine.keys() & truth.keys())
        total += len(truth)
        assert all(mine[v] == truth[v] for v in mine.keys() & truth.keys())
    return hit / total


def test_recall_on_the_test_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = exact(rows, lambda i: i % 20 == 0, 20)
    got = QUERIES["op10_nearest_neighbours"](spark, SF).collect()
    assert {r["query_id"] for r in got} == set(want)
    for q in list(want)[:20]:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_with_a_sample_smaller_than_the_table(spark, clustered):
    """Trees fitted on 512 of about 2,000 vectors, those of the test table and clustered ones."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    if clustered:
        rng = np.random.default_rng(7)
        centres = rng.normal(size=(25, 32))
        made = [(i, [float(v) for v in centres[i % 25] + 0.3 * rng.normal(size=32)]) for i in range(2000)]
        vectors = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert len(rows) > 3 * 512
    want = exact(rows, lambda i: i % 20 == 0, 20)
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20, sample=512).collect()
    assert recall(got, want) >= 0.9, recall(got, want)


def test_vectors_that_take_no_part_copies_and_ties(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[20][1]) for i in range(60)]  # copies of a query
    good = list(rows)
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [float("inf")] * 8), (304, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("key", F.lit("k"))
    got = ann.nearest(df.repartition(4), F.col("vec_id") % 20 == 0, k=20, block=16, leaf=16).collect()
    want = exact(good, lambda i: i % 20 == 0, 20)
    assert {r["query_id"] for r in got} == set(want)
    assert recall(got, want) >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 20), key=lambda r: r["rank"])] == list(range(200, 220))


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(few, F.col("vec_id") == 0, k=20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 0.5), (2, 2, 0.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0
