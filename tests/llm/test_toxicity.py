import random
import zlib

import numpy as np
import pytest
from fixtures_path import fixtures as fx
from pyspark.sql import functions as F

from edgeline.llm import toxicity
from edgeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = QUERIES["op13_toxicity"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    caught = [r["predicted"] for r in held if r["toxic"] == 1]
    alone = [1 - r["predicted"] for r in held if r["toxic"] == 0]
    # 5 of the 97 held-out rows marked toxic are clean junk that holds no word of the others
    assert len(caught) == 97 and sum(caught) >= 86 and np.mean(alone) >= 0.98


def texts(seed, n):
    """Clean and marked texts; the mark is a word, or a word that begins in a way no other does."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "e", "on"]) for _ in range(rng.randint(5, 120))]
        for _ in range(3 * (i % 2)):
            words[rng.randrange(len(words))] = rng.choice(["zzgrim,", f"Vexo{rng.choice('abcdefgh')}{rng.randint(0, 99)}"])
        out.append(" ".join(words).encode())
    return out, np.arange(n) % 2


def test_learns_marks_it_has_not_seen_and_reruns_agree():
    t, y = texts(1, 200)
    net = toxicity.train(t, y)
    new, truth = texts(2, 200)
    assert np.mean((net.score(new) >= 0.5) == truth) > 0.95
    assert net.score([b""])[0] < 0.5
    again = toxicity.train(t, y).score(new)
    assert (again == net.score(new)).all()
    # one by one, in a batch, and within a long text: every window of a text counts
    assert net.score(new[:5]) == pytest.approx([net.score([x])[0] for x in new[:5]], abs=1e-5)
    clean = b" ".join(x for x, k in zip(new, truth, strict=True) if not k)
    assert net.score([clean * 20 + b" zzgrim vexoa1 zzgrim"])[0] > 0.5


def test_windows_overlap_and_cover_the_text():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        x = toxicity.Inputs([b"solo", b" ".join(b"w%d" % i for i in range(n)), b""])
        start, text = x.windows()
        at, mask = x.fill(start, text)
        mine = [set((s - x.first[1]) + np.flatnonzero(m)) for s, t, m in zip(start, text, mask, strict=True) if t == 1]
        assert set().union(*mine) == set(range(n))
        assert all(len(a & b) >= 1 for a, b in zip(mine, mine[1:], strict=False))
        assert (text == 2).sum() == 1 and mask[text == 2].sum() == 0


def test_gradients_against_differences(monkeypatch):
    t, y = texts(3, 80)
    net = toxicity.train(t, y, words=20, strings=20, rounds=1, epochs=1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x = toxicity.Inputs(t[:12])
    known = net.known(x)
    start, text = x.windows()
    at, mask = x.fill(start, text)
    aim = y[text].astype(float)

    def loss():
        logit = net.run(net.project(net.inputs(known)), at, mask)[3]
        return np.mean(np.logaddexp(0, logit) - aim * logit)

    g = net.gradients(known, at, mask, aim)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(4):
            i = tuple(rng.integers(1 if k in ("words", "chars") else 0, s) for s in v.shape)
            old, step = v[i], 1e-2
            v[i] = old + step
            up = loss()
            v[i] = old - step
            down = loss()
            v[i] = old
            assert g[k][i] == pytest.approx((up - down) / (2 * step), abs=2e-4), k


@pytest.mark.parametrize("clash", [False, True])
def test_scores_of_messy_rows(spark, clash):
    docs = fx.messy_rows()
    df = fx.frame(spark, docs, clash)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(2, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(df, labels).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["id"] in (3, 4, 5)}
    assert len(blank) == 1


def test_held_out_labels_teach_nothing(spark):
    docs = fx.frame(spark, fx.messy_rows())
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.bucket(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r["id"]), r["score"]) for r in toxicity.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_one_class_and_no_rows(spark):
    df = fx.frame(spark, fx.messy_rows())
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(df, labels).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score(fx.empty(spark), labels).count() == 0
