import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures_path import fixtures as fx

from edgeline.llm import katz
from edgeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def out_of(i, folds=7, fold=2):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


class Slow:
    """The same model with dictionaries, token by token."""

    def __init__(self, docs, vocabulary, k=5):
        train = [tokens(t) for i, t in docs if i is not None and not out_of(i)]
        self.c = Counter(w for ts in train for w in ts)
        self.n, self.v, self.k = sum(self.c.values()), len(self.c), k
        self.vocabulary = vocabulary
        self.pairs = Counter(p for ts in train for p in zip(["<s>", *map(self.klass, ts)], map(self.klass, ts), strict=False))
        of = Counter(self.pairs.values())
        self.d = dict(enumerate(katz.discounts(of, k), 1))
        self.rows = {}
        for (a, b), n in self.pairs.items():
            self.rows.setdefault(a, {})[b] = n

    def klass(self, w):
        return w if w is None or w in self.vocabulary else "<other>"

    def p1(self, w):
        return (self.c[w] + 1) / (self.n + self.v + 1)

    def pc(self, w):
        if w == "<other>":
            return 1 - sum(self.p1(x) for x in self.vocabulary) - self.p1(None)
        return self.p1(w)

    def chance(self, prev, cur):
        row = self.rows.get(prev)
        if not row:
            return self.pc(cur)
        kept = {w: n * self.d.get(n, 1.0) for w, n in row.items()}
        t, s, b = sum(row.values()), sum(kept.values()), sum(self.pc(w) for w in row)
        if 1 - b < 1e-12:
            t = s
        elif t - s < 1e-9 * t:
            t += 1
        return kept[cur] / t if cur in kept else (t - s) / t / (1 - b) * self.pc(cur)

    def score(self, text):
        total, prev = 0.0, "<s>"
        for w in tokens(text):
            cur = self.klass(w)
            total += math.log10(self.chance(prev, cur))
            if cur == "<other>":
                total += math.log10(self.p1(w) / self.pc(cur))
            prev = cur
        return total


def check(rows, docs, vocabulary):
    from edgeline.llm.common import Words

    train = Counter(w for i, t in docs if i is not None and not out_of(i) for w in tokens(t)[:-1])
    names = list(train)
    hashes = [int(np.int64(Words([w.encode()]).hash[0].astype(np.int64))) for w in names]
    order = sorted(range(len(names)), key=lambda i: (-train[names[i]], hashes[i]))
    slow = Slow(docs, {names[i] for i in order[:vocabulary]})
    want = []
    for i, t in docs:
        ts = tokens(t)
        base = sum(math.log10((slow.c[w] + 1) / (slow.n + slow.v + 1)) for w in ts)
        want.append((str(i), out_of(i), len(ts), sum(slow.c[w] > 0 for w in ts), slow.n, base, slow.score(t)))
    got = [(str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows]
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return slow


@pytest.mark.parametrize(("vocabulary", "common", "cached"), [(40, 60, 50), (5, 5, 0), (10_000, 10_000, 10_000)])
def test_messy_rows_against_dictionaries(spark, vocabulary, common, cached):
    docs = fx.messy_rows()
    rows = katz.score_texts(fx.frame(spark, docs, clash=True), vocabulary=vocabulary, common=common, cached=cached).collect()
    slow = check(rows, [(d[0], d[1]) for d in docs], vocabulary)
    classes = [*slow.vocabulary, None, "<other>"]
    for prev in random.Random(1).sample(sorted(map(str, slow.rows)), min(8, len(slow.rows))):
        prev = None if prev == "None" else prev
        assert sum(slow.chance(prev, c) for c in classes) == pytest.approx(1.0)


class Whole(Slow):
    """All words have bigrams; sums over a context's row are made once."""

    def __init__(self, docs, vocabulary, k=5):
        super().__init__(docs, vocabulary, k)
        self.sums = {}
        for prev, row in self.rows.items():
            kept = {w: n * self.d.get(n, 1.0) for w, n in row.items()}
            t, s = sum(row.values()), sum(kept.values())
            self.sums[prev] = kept, t + 1 if t - s < 1e-9 * t else t, s, sum(self.p1(w) for w in row)

    def pc(self, w):
        return 1 / (self.n + self.v + 1) if w == "<other>" else self.p1(w)

    def chance(self, prev, cur):
        if prev not in self.sums:
            return self.pc(cur)
        kept, t, s, b = self.sums[prev]
        return kept[cur] / t if cur in kept else (t - s) / t / (1 - b) * self.pc(cur)


@pytest.mark.parametrize("bounds", [{}, {"common": 300, "cached": 200}, {"common": 300, "cached": 0, "longest": 3}])
def test_every_word_has_bigrams(spark, monkeypatch, bounds):
    """26,000 words, far more than are frequent; the bounds on what tasks hold change nothing."""
    monkeypatch.setitem(globals(), "Slow", Whole)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [tuple(d) for d in table.select("doc_id", "text").collect()]
    rows = katz.score_texts(table, **bounds) if bounds else QUERIES["op7_katz_scores"](spark, SF).withColumnRenamed("doc_id", "id")
    rows = rows.collect()
    slow = check(rows, docs, 10**9)
    assert len(slow.vocabulary) > 20_000
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    for prev in ["<s>", *random.Random(3).sample(sorted(slow.vocabulary), 3)]:
        assert sum(slow.chance(prev, c) for c in [*slow.vocabulary, None, "<other>"]) == pytest.approx(1.0)


def test_no_training_rows_and_no_rows(spark):
    only = [(i, "a b c", "en", "s") for i in range(200) if out_of(i)]
    rows = katz.score_texts(fx.frame(spark, only)).collect()
    assert len(rows) == len(only)
    assert all((r["score"], r["base_score"], r["n_known"], r["train_tokens"]) == (0.0, 0.0, 0, 0) for r in rows)
    assert katz.score_texts(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("longest", [1, 2, 5, 1 << 20])
def test_a_bigram_of_any_number_of_texts(spark, monkeypatch, longest):
    """Bigrams of many texts, taught and not, gathered or passed on as they come."""
    monkeypatch.setitem(globals(), "Slow", Whole)
    docs = [(i, f"same words here {i % 3} w{i}" if i % 2 or out_of(i) else "other ones", "en", "s") for i in range(60)]
    docs += [(i, "never taught pair", "en", "s") for i in range(60, 200) if out_of(i)]
    rows = katz.score_texts(fx.frame(spark, docs), common=2, cached=4, longest=longest).collect()
    check(rows, [(d[0], d[1]) for d in docs], 10**9)


@pytest.mark.parametrize("longest", [5, 1 << 20])
def test_bigrams_that_share_a_key(spark, monkeypatch, longest):
    monkeypatch.setitem(globals(), "Slow", Whole)
    xxhash64 = katz.F.xxhash64
    monkeypatch.setattr(katz.F, "xxhash64", lambda c: katz.F.pmod(xxhash64(c), katz.F.lit(2)) * (1 << 32))
    docs = [(i, f"a{i % 5} b{i % 3} c{i % 7} d{i} never{i % 9}", "en", "s") for i in range(90)]
    rows = katz.score_texts(fx.frame(spark, docs), common=2, cached=4, longest=longest).collect()
    check(rows, [(d[0], d[1]) for d in docs], 10**9)


def test_discounts():
    assert katz.discounts({}, 5) == [1.0] * 5
    d = katz.discounts({1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 40}, 5)
    assert all(0 < x <= 1 for x in d)
    assert d[0] == pytest.approx((2 * 300 / 1000 - 6 * 40 / 1000) / (1 - 6 * 40 / 1000))
