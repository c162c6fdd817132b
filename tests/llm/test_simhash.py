import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from fixtures_path import fixtures as fx

from edgeline.llm import fingerprints, neardup
from edgeline.llm.bktree import Forest
from edgeline.llm.components import components
from edgeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_simhash(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64)) if hashes else 0


def slow_groups(prints, radius):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def check_groups(rows, docs, k=4, radius=4):
    prints = [slow_simhash(t, k) for _, t in docs]
    roots = slow_groups(prints, radius)
    least = {}
    for (i, _), r in zip(docs, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(docs, prints, roots, strict=True)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def named(df):
    from pyspark.sql import functions as F

    return df.select(F.col("id").alias("doc_id"), fingerprints.hex16(F.col("bits")).alias("fingerprint"), "component_id").collect()


@pytest.mark.parametrize("clash", [False, True])
def test_groups_of_messy_rows(spark, clash):
    docs = fx.messy_rows()
    check_groups(named(neardup.near_groups(fx.frame(spark, docs, clash))), [(d[0], d[1]) for d in docs])


def test_groups_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_groups(QUERIES["op6_simhash_near_dedup"](spark, SF).collect(), [tuple(d) for d in docs])


def test_groups_of_nothing(spark):
    assert neardup.near_groups(fx.empty(spark)).count() == 0
    assert neardup.drop_near_copies(fx.empty(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = fx.messy_rows()
    df = fx.frame(spark, docs, clash=True)
    out = neardup.drop_near_copies(df)
    assert out.columns == df.columns
    kept = out.select("doc_id", "text").collect()
    groups = neardup.near_groups(df)
    assert len(kept) == groups.select("group").distinct().count()
    ids = {r["component_id"] for r in groups.select("component_id").collect()}
    assert {r["doc_id"] for r in kept} == ids


def test_links_reach_all_pairs_in_hot_shards(spark):
    """A dense cluster and random fingerprints, cut into small chunks."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for _ in range(150)}
    prints |= {rng.getrandbits(64) for _ in range(150)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "bits long")
    links = neardup.links(df, radius=4, chunk=16)
    for r in links.collect():
        assert r["a"] != r["b"]
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got, want = [roots.get(p, p) for p in signed], slow_groups(prints, 4)
    same = {}
    for g, w in zip(got, want, strict=True):
        assert same.setdefault(g, w) == w
    assert len(set(got)) == len(set(want))


def test_tree_search_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300).astype(np.uint64) & np.uint64(0xFFFFF)
    group = np.sort(rng.integers(0, 7, 300))
    forest = Forest(prints, group)
    got = set()
    for q, t in forest.search(prints, forest.root, 4, block=64):
        got |= set(zip(q.tolist(), t.tolist(), strict=True))
    want = {(i, j) for i in range(300) for j in range(300) if group[i] == group[j] and bin(int(prints[i] ^ prints[j])).count("1") <= 4}
    assert got == want


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        assert got[start] == min(seen)
    assert set(got) == set(near)


def slow_edits(docs):
    order = sorted(docs, key=lambda d: d[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t = t or ""
        after = order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited, after)
    return out


def test_edited_fingerprints_of_the_test_table(spark):
    docs = [tuple(d) for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = slow_edits(docs)
    rows = QUERIES["op5_fingerprints"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    text = dict(docs)
    for r in rows:
        n, sha, edited, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        a, b, c = (int(x) for x in fingerprints.weighted_simhash([text[r["doc_id"]].encode(), edited.encode(), after.encode()]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{a:016x}", f"{b:016x}")
        assert r["near_edited"] == 1 - bin(a ^ b).count("1") / 64
        assert r["near_next"] == 1 - bin(a ^ c).count("1") / 64
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.1


@pytest.mark.parametrize("size", [3, 4096])
def test_edits_of_messy_rows(spark, size):
    docs = [(i, t, x, s) for i, t, x, s in fx.messy_rows() if i is not None]
    ids = [d[0] for d in docs]
    single = [d for d in docs if ids.count(d[0]) == 1]
    want = slow_edits([(d[0], d[1]) for d in single])
    rows = fingerprints.with_edits(fx.frame(spark, single, clash=True), rows_a_part=size).collect()
    assert {(r["id"], r["n_chars"], r["edited_sha256"]) for r in rows} == {(i, *w[:2]) for i, w in want.items()}
    everything = fx.messy_rows()
    assert fingerprints.with_edits(fx.frame(spark, everything), rows_a_part=size).count() == len(everything)
    assert fingerprints.with_edits(fx.empty(spark)).count() == 0


def test_weighted_simhash_against_a_loop():
    rng = random.Random(1)
    texts = ["", "  ", "a", "A b", "x y z " * 50, *[fx.words(rng, n, 12) for n in (3, 40, 900)]]
    got = fingerprints.weighted_simhash([t.encode() for t in texts])
    from edgeline.llm.common import Words

    for t, g in zip(texts, got, strict=True):
        w = Words([t.encode()])
        if len(w.hash) < 3:
            continue
        terms, _ = w.shingles(3)
        votes = np.zeros(64)
        for term in set(terms.tolist()):
            weight = 1 + np.log(terms.tolist().count(term))
            for b in range(64):
                votes[b] += weight if term >> b & 1 else -weight
        assert int(g) == sum(int(v > 0) << b for b, v in enumerate(votes))


def test_block_tables_find_all_pairs(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [b ^ (7 << 5) for b in base]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = {(r["a"], r["b"], r["distance"]) for r in fingerprints.within_radius(spark.createDataFrame([(s,) for s in signed], "bits long"), 3).collect()}
    mask = (1 << 64) - 1
    want = {(a, b, bin((a ^ b) & mask).count("1")) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 3}
    assert got == want
