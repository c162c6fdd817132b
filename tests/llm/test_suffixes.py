import hashlib
import inspect
import random
import tracemalloc

import numpy as np
import pytest
from fixtures_path import fixtures as fx

from edgeline.llm import suffixes
from edgeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow(docs, length):
    least = {}
    for i, t in docs:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p : p + length]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        if i is not None:
            for p in range(len(t) - length + 1):
                if least[t[p : p + length]] < i:
                    gone[p : p + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_test_table_against_all_strings(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op9_suffix_array_dedup"](spark, SF).collect()
    want = slow(docs, 50)
    assert sum(w[2] for w in want) > 0
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows], want)


@pytest.mark.parametrize(("hot", "held"), [(50_000, 4 << 20), (3, 500), (0, 1)])
def test_messy_rows_against_all_strings(spark, hot, held):
    rng = random.Random(4)
    docs = [(d[0], d[1], d[2], d[3]) for d in fx.messy_rows()]
    passage = fx.words(rng, 30)
    docs += [(2000 + i, fx.words(rng, 12) + passage[rng.randint(0, 9) :] + fx.words(rng, 12), "en", "s") for i in range(25)]
    docs += [(3000, "a" * 400, "en", "s"), (3001, "a" * 90 + "b" + "a" * 60, "en", "s"), (3002, "ab" * 100, "en", "s"), (3003, "\0" * 70, "en", "s"), (3004, "\0" * 70, "en", "s")]
    docs += [(3005, docs[6][1], "en", "s"), (3005, "another text of the same id " * 9, "en", "s")]
    rows = suffixes.repeats(fx.frame(spark, docs, clash=True), length=40, hot=hot, held=held).collect()
    got = [(r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows]
    same(got, slow([(d[0], (d[1] or "").encode()) for d in docs], 40))


def test_no_rows(spark):
    assert suffixes.repeats(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 30, 31, 32, 301]:
        s = rng.integers(1, letters + 1, n)
        assert suffixes.suffix_order(s, n + 1).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_order_to_a_depth():
    rng = np.random.default_rng(1)
    for depth in (3, 4, 9, 10, 20):
        s = rng.integers(1, 3, 400)
        order = suffixes.suffix_order(s, depth)
        assert sorted(order.tolist()) == list(range(400))
        heads = [s[i : i + depth].tolist() for i in order]
        assert heads == sorted(heads)


@pytest.mark.parametrize("bits", [64, 30, 26])
def test_equal_windows_have_equal_pivots_whatever_lies_around(monkeypatch, bits):
    """Coarse hashes, so that strings agree in the high bits; slices from one window to a megabyte."""
    hashes = suffixes.grams
    monkeypatch.setattr(suffixes, "grams", lambda raw, k: hashes(raw, k) & ~np.uint64((1 << (64 - bits)) - 1))
    rng = random.Random(2)
    passage = bytes(rng.choice(b"ab") for _ in range(300))
    pivot = {}
    for around in (0, 1, 1000, 1 << 20):
        text = bytes(rng.choice(b"cd") for _ in range(around)) + passage + b"x" * around
        for at_once in (64, 1 << 23) if around <= 1000 else (1 << 23,):
            p = suffixes.Pivots([b"short", text, b"", passage], 50, 24, at_once)
            for d, s, w, h in zip(p.doc.tolist(), p.start.tolist(), p.windows.tolist(), p.hash.tolist(), strict=True):
                for i in range(s, s + w):
                    window = text[i : i + 50] if d == 1 else passage[i : i + 50]
                    if window in passage:
                        assert pivot.setdefault(window, h) == h
    assert len(pivot) >= 200


def test_strings_without_a_shared_window_are_left_out():
    owner = np.array([1, 1, 2, 3])
    text = [b"a" * 30 + b"b" * 30, b"a" * 30 + b"b" * 30, b"z" * 12 + b"a" * 10 + b"b" * 30, b"q" * 60]
    item, at = suffixes.copies(text, owner, 40)
    assert set(zip(item.tolist(), at.tolist(), strict=True)) == {(2, 12)}
    assert [len(x) for x in suffixes.copies([b"q" * 60, b"r" * 60], np.array([1, 2]), 40)] == [0, 0]


def test_a_portion_of_strings_is_sorted_in_little_memory():
    held = inspect.signature(suffixes.spans_of).parameters["held"].default
    rng = np.random.default_rng(1)
    text, size = [], 0
    while size < held:
        base = rng.integers(97, 123, 60).astype(np.uint8).tobytes()
        text += [base[:n] for n in rng.integers(52, 61, 2)]
        size += len(text[-1]) + len(text[-2])
    tracemalloc.start()
    suffixes.copies(text, np.arange(len(text)), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


@pytest.mark.parametrize("whole", [0, 1 << 62])
def test_suffix_order_of_numbers_too_large_to_pair(monkeypatch, whole):
    monkeypatch.setattr(suffixes, "WHOLE", whole)
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 10, 200):
        for most in (2, 5, 1 << 20):
            s = rng.integers(1, most + 1, n)
            assert suffixes.suffix_order(s, n + 3).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_portions_of_a_text_have_the_same_windows():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (0, 30, 700, 49, 50, 2000, 0)]

    def windows(at_once):
        p = suffixes.Pivots(texts, 50, 24, at_once)
        return [(d, s + i, h) for d, s, w, h in zip(p.doc.tolist(), p.start.tolist(), p.windows.tolist(), p.hash.tolist(), strict=True) for i in range(w)]

    assert windows(100) == windows(1 << 23) and len(windows(100)) == 651 + 1 + 1951
