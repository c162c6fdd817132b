import random

import numpy as np
import pytest
from fixtures_path import fixtures as fx

from edgeline.llm import passages
from edgeline.llm.common import Words
from edgeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_windows(v, least):
    """(l, c, r) of all positions smallest in a stretch of at least ``least``, leftmost on ties."""
    out = []
    for c in range(len(v)):
        l = r = c
        while l > 0 and v[l - 1] > v[c]:
            l -= 1
        while r < len(v) - 1 and v[r + 1] >= v[c]:
            r += 1
        if r - l + 1 >= least:
            out.append((l, c, r))
    return out


def test_compact_windows():
    rng = np.random.default_rng(5)
    for least in (1, 3, 7):
        sizes = [0, 40, 2, 7, 25, 1]
        v = rng.integers(0, 1 << 40, sum(sizes)).astype(np.uint64) << np.uint64(20)
        first = np.concatenate([[0], np.cumsum(sizes)])
        d, l, c, r = passages.compact_windows(v, first, least)
        got = list(zip(d.tolist(), l.tolist(), c.tolist(), r.tolist(), strict=True))
        want = [(i, *w) for i in range(len(sizes)) for w in slow_windows(v[first[i] : first[i + 1]].tolist(), least)]
        assert got == want


def unique(rng, n):
    return [f"{rng.getrandbits(48):x}" for _ in range(n)]


def planted(seed=2):
    """Documents of unique words; some share a passage, exactly or with changed words."""
    rng = random.Random(seed)
    shared = unique(rng, 70)
    longer = unique(rng, 400)
    rows, want = [], {}
    for i in range(120):
        body = unique(rng, rng.randint(60, 400))
        at = rng.randint(0, len(body))
        if i % 4 == 0:
            body[at:at] = shared
            want[i] = (at, at + 70)
        elif i % 10 == 3:
            words = list(longer)
            for p in range(30, 400, 60):
                words[p] = unique(rng, 1)[0]
            body[at:at] = words
            want[i] = (at, at + 400)
        rows.append((i, " ".join(body), "en", "s"))
    return rows, want


def covered(rows, i):
    out = set()
    for r in rows:
        if r["id"] == i:
            out |= set(range(r["start"], r["stop"]))
    return out


def longest_ranges(a, b, least, similarity):
    """Positions of a in any range, begun and ended by common tokens, that is similar to some range of b."""
    got = set()
    pos = [p for p, t in enumerate(a) if t in set(b)]
    for i in pos:
        for j in pos:
            if j - i + 1 < least:
                continue
            one = set(a[i : j + 1])
            where = [q for q, t in enumerate(b) if t in one]
            two = set(b[min(where) : max(where) + 1])
            if len(one & two) / len(one | two) >= similarity:
                got |= set(range(i, j + 1))
    return got


def test_compare_finds_what_brute_force_over_ranges_finds():
    rng = random.Random(8)
    for trial in range(40):
        base = list(range(1, rng.randint(50, 120)))
        copy, p = [], 0
        while p < len(base):
            kind = rng.random()
            if kind < 0.02:
                copy += [rng.randrange(1000, 1 << 40) for _ in range(rng.randint(1, 16))]
            elif kind < 0.04:
                p += rng.randint(1, 9)
            elif kind < 0.07:
                copy += [rng.randrange(1000, 1 << 40) for _ in range(5)]
                p += 5
            copy += base[p : p + 1]
            p += 1
        a = [rng.randrange(1000, 1 << 40) for _ in range(20)] + copy + [rng.randrange(1000, 1 << 40) for _ in range(20)]
        rows = passages.compare(np.array(a, np.uint64), np.array(base, np.uint64), 46, 0.8)
        got = {p for lo, hi, *_ in rows for p in range(lo, hi)}
        assert got == longest_ranges(a, base, 46, 0.8), trial
        for lo, hi, s, e, score in rows:
            one, two = set(a[lo:hi]), set(base[s:e])
            assert hi - lo >= 46 and score == len(one & two) / len(one | two) >= 0.8


def test_ten_words_inserted_in_the_middle(spark):
    rng = random.Random(4)
    body = unique(rng, 98)
    docs = [(1, " ".join(body), "en", "s"), (2, " ".join(body[:49] + unique(rng, 10) + body[49:]), "en", "s")]
    rows = passages.passages(fx.frame(spark, docs)).collect()
    assert [(r["id"], r["start"], r["stop"], r["other"]) for r in rows] == [(2, 0, 108, 1)]
    assert abs(rows[0]["similarity"] - 90 / 108) < 1e-9


def test_planted_passages(spark):
    docs, want = planted()
    rows = passages.passages(fx.frame(spark, docs)).collect()
    firsts = {0, 3}
    assert {r["id"] for r in rows} == set(want) - firsts
    assert {r["other"] for r in rows} >= firsts
    for i in set(want) - firsts:
        lo, hi = want[i]
        got = covered(rows, i)
        # ends may be cut by a changed word's shingles, or grow by none
        assert got <= set(range(lo, hi))
        assert len(got) >= (hi - lo) - 40 if hi - lo == 400 else len(got) == hi - lo


def test_every_passage_is_similar_and_long(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_substring_dedup"](spark, SF).collect()
    assert rows
    for r in rows:
        assert r["other_id"] < r["doc_id"]

        def tokens(i, lo, hi):
            w = Words([(docs[i] or "").encode()])
            t, _ = w.shingles(5)
            return set(t[lo : hi - 4].tolist())

        a, b = tokens(r["doc_id"], r["start"], r["stop"]), tokens(r["other_id"], r["other_start"], r["other_stop"])
        assert len(a & b) / len(a | b) >= 0.8
        assert r["stop"] - r["start"] >= 50


def exact_stretches(docs, n=60):
    """Documents with n words in a row that an earlier document also has."""
    seen, out = {}, set()
    for i, t in sorted(docs):
        w = (t or "").lower().split()
        mine = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
        if any(seen.get(m, i) < i for m in mine):
            out.add(i)
        for m in mine:
            seen.setdefault(m, i)
    return out


def test_exact_repeats_of_the_test_table_are_found(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = {r["doc_id"] for r in QUERIES["op2_substring_dedup"](spark, "/root/testdata/sf0.01").collect()}
    want = exact_stretches(docs)
    assert len(want - found) <= 0.02 * len(want), sorted(want - found)


def test_recall_at_the_threshold(spark):
    """Passages of 50 to 60 words with one changed word (similarity 0.80 to 0.84) in texts of other words."""
    rng = random.Random(11)
    docs, want = [], set()
    for i in range(0, 1600, 2):
        shared = unique(rng, rng.randint(50, 60))
        changed = list(shared)
        changed[rng.randint(10, len(shared) - 11)] = unique(rng, 1)[0]
        for n, words in ((i, shared), (i + 1, changed)):
            docs.append((n, " ".join(unique(rng, rng.randint(20, 60)) + words + unique(rng, rng.randint(20, 60))), "en", "s"))
        a, b = (Words([d[1].encode()]).shingles(5)[0].tolist() for d in (docs[-1], docs[-2]))
        if longest_ranges(a, b, 46, 0.8):
            want.add((i + 1, i))
    assert len(want) == 800
    got = {(r["id"], r["other"]) for r in passages.passages(fx.frame(spark, docs)).collect()}
    assert got <= want
    assert len(got) >= 0.993 * len(want), len(got)


@pytest.mark.parametrize("size", [25, 30, 40])
def test_passages_of_lines_seen_alone_earlier(spark, size):
    """Every passage is two lines, each alone in an earlier document of its own; the copies come later."""
    rng = random.Random(size)
    lines, copies, want = [], [], {}
    for p in range(100):
        one, two = unique(rng, size), unique(rng, size)
        lines += [unique(rng, 40) + one + unique(rng, 40), unique(rng, 40) + two + unique(rng, 40)]
        for n in range(3):
            at = 1000 + 3 * p + n
            copies.append((at, " ".join(unique(rng, 40) + one + two + unique(rng, 40)), "en", "s"))
            if n:
                want[at] = 1000 + 3 * p
    docs = [(i, " ".join(x), "en", "s") for i, x in enumerate(lines)] + copies
    rows = passages.passages(fx.frame(spark, docs)).collect()
    assert {r["id"]: r["other"] for r in rows if r["other"] == want.get(r["id"])} == want
    for i in want:
        assert covered(rows, i) == set(range(40, 40 + 2 * size))


def test_a_line_that_the_first_document_holds_twice(spark):
    rng = random.Random(6)
    line, rest = unique(rng, 40), unique(rng, 40)
    docs = [(1, " ".join(line + unique(rng, 90) + line + rest), "en", "s"), (2, " ".join(unique(rng, 30) + line + rest), "en", "s")]
    rows = passages.passages(fx.frame(spark, docs)).collect()
    assert covered(rows, 2) == set(range(30, 110))


def test_no_exact_repeat_of_the_test_table_is_missing(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = {r["doc_id"] for r in QUERIES["op2_substring_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert exact_stretches(docs) <= found


@pytest.mark.parametrize("clash", [False, True])
def test_messy_rows(spark, clash):
    docs = fx.messy_rows()
    df = fx.frame(spark, docs, clash)
    rows = passages.passages(df).collect()
    long_copies = {i for i, t, *_ in docs if i is not None and 900 <= i and len((t or "").split()) >= 50}
    assert long_copies <= {r["id"] for r in rows} | {30}
    out = passages.drop_passages(df)
    assert out.columns == df.columns
    kept = out.select("doc_id", "text").collect()
    gone = {i for i, *_ in docs if i is not None} - {r["doc_id"] for r in kept}
    assert gone == long_copies | ({7, 8} - {min(7, 8)} if len(docs[8][1].split()) >= 50 else set()) | gone & {22}
    assert sum(r["doc_id"] is None for r in kept) == sum(d[0] is None for d in docs)


def test_dropped_passages_leave_the_rest(spark):
    docs, want = planted()
    kept = {r["doc_id"]: r["text"] for r in passages.drop_passages(fx.frame(spark, docs)).collect()}
    assert set(kept) == {d[0] for d in docs}
    for i, text, *_ in docs:
        words = text.split()
        if i not in want or i in (0, 3):
            assert kept[i] == text
        else:
            lo, hi = want[i]
            assert set(words[:lo] + words[hi:]) <= set(kept[i].split())
            if hi - lo == 70:
                assert kept[i].split() == words[:lo] + words[hi:]


def test_no_rows(spark):
    assert passages.passages(fx.empty(spark)).count() == 0
    assert passages.drop_passages(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_every_text_of_an_id_is_searched(spark, seed):
    """Ids with two texts, the passage in the first or the second of them, whichever hash is smaller."""
    rng = random.Random(seed)
    shared = unique(rng, 60)
    rows, want = [], set()
    for i in range(12):
        texts = [unique(rng, 90), unique(rng, 90)]
        which = rng.randint(0, 1)
        texts[which][20:20] = shared
        rows += [(i, " ".join(t), "en", "s") for t in texts]
        if i:
            want.add((i, 20, 80))
    rows += [(50, rows[1][1], "en", "s"), (50, " ".join(unique(rng, 70)), "en", "s")]  # the copy of one text under another id
    rows += [(60, " ".join(shared), "en", "s"), (60, " ".join(unique(rng, 5) + shared), "en", "s")]  # an id's own texts share a passage
    got = passages.passages(fx.frame(spark, rows)).collect()
    assert want <= {(r["id"], r["start"], r["stop"]) for r in got}
    assert all(r["other"] < r["id"] for r in got)
    out = passages.drop_passages(fx.frame(spark, rows)).collect()
    assert sum(" ".join(shared) in (r["text"] or "") for r in out) == 1
    assert rows[1][1] not in [r["text"] for r in out if r["doc_id"] == 50]


def test_groups_are_read_as_they_come():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate([rng.integers(0, 300, 900), np.full(500, 77)]))
    ids, place = rng.integers(0, 40, len(key)), rng.integers(0, 1 << 40, len(key))
    order = np.lexsort((place, ids, key))
    key, ids, place = key[order], ids[order], place[order]
    want = []
    for k in np.unique(key):
        mine = key == k
        if len(set(ids[mine])) > 1:
            want += [(k, i, p, ids[mine][0], place[mine][0], mine.sum() > 2) for i, p in zip(ids[mine], place[mine], strict=True)]
    for size in (1, 7, 100, 5000):
        for held in (1, 20, 1 << 16):
            cuts = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (key, ids, place)], names=["key", "id", "place"]) for i in range(0, len(key), size)]
            got = [tuple(r.values()) for b in passages.lead_links(cuts, held) for r in b.to_pylist()]
            assert [g[:5] for g in got] == [tuple(int(v) for v in w[:5]) for w in want]
            assert [g[5] for g in got] == [bool(w[5]) for w in want]


def test_keys_that_begin_with_a_marked_row_are_left_out():
    import pyarrow as pa

    key = np.repeat([1, 2, 3], [4, 3, 3])
    ids = np.array([5, 6, 7, 7, 1, 2, 3, 4, 5, 6])
    place = np.array([passages.marked(9), 1, 2, 3, 4, 5, 6, passages.marked(7), 8, 9])
    for size in (1, 3, 100):
        for held in (1, 1 << 16):
            cuts = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (key, ids, place)], names=["key", "id", "place"]) for i in range(0, len(key), size)]
            got = [tuple(r.values())[:5] for b in passages.lead_links(cuts, held) for r in b.to_pylist()]
            assert got == [(2, 1, 4, 1, 4), (2, 2, 5, 1, 4), (2, 3, 6, 1, 4)]


def test_links_within_a_group_come_once():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted({(int(k), int(i), int(p)) for k, i, p in zip(rng.integers(0, 30, 600), rng.integers(0, 50, 600), rng.integers(0, 1 << 40, 600), strict=True)})
    finer = [[int(k) * 100 + int(v) for v in rng.integers(0, 6, rng.integers(0, 9))] for k, _, _ in rows]
    heads = {k: (i, p) for k, i, p in reversed(rows)}
    want, first = set(), {}
    for (k, i, p), keys in zip(rows, finer, strict=True):
        for f in keys:
            lead = first.setdefault(f, (i, p))
            if lead[0] != i and lead != heads[k]:
                want.add((i, lead[0], p, lead[1]))
    assert want
    cols = [np.array([r[n] for r in rows]) for n in range(3)]
    cols[2] = np.array([passages.marked(np.int64(p)) if heads[k] == (i, p) else p for k, i, p in rows])
    for size in (1, 7, 100, 5000):
        cuts = [
            pa.RecordBatch.from_arrays([*(pa.array(x[i : i + size]) for x in cols), pa.array(finer[i : i + size], pa.list_(pa.int64()))], names=["key", "id", "place", "finer"])
            for i in range(0, len(rows), size)
        ]
        got = [r for b in passages.links_within(cuts) for r in b.to_pylist()]
        links = [(r["id"], r["lead"], x["place"], x["lead_place"]) for r in got for x in r["items"]]
        assert all(r["finer"] is None for r in got) and len(links) == len(want) and set(links) == want
        assert len(got) == len({w[:2] for w in want})
        for held in (0, 3):
            got = [r for b in passages.links_within(cuts, held) for r in b.to_pylist()]
            later = sorted((r["finer"], r["id"], r["place"]) for r in got if r["finer"] is not None)
            assert bool(later) == (size < 100)
            batch = pa.RecordBatch.from_arrays([pa.array([x[n] for x in later], pa.int64()) for n in range(3)], names=["key", "id", "place"])
            more = [tuple(r.values()) for b in passages.lead_links([batch]) for r in b.to_pylist()]
            links = {(r["id"], r["lead"], x["place"], x["lead_place"]) for r in got if r["finer"] is None for x in r["items"]}
            assert links | {(m[1], m[3], m[2], m[4]) for m in more if m[1] != m[3]} == want
    assert sum(b.num_rows for b in passages.links_within([])) == 0


def test_windows_as_numbers():
    c, left, right, k = np.array([0, 5, 1 << 30]), np.array([0, 5, 9000]), np.array([3, 0, 1 << 20]), np.array([0, 15, 3])
    place = passages.packed(c, left, right, k, 92)
    assert (np.diff(place) > 0).all()
    got = passages.unpacked(place)
    assert [x.tolist() for x in got] == [[0, 15, 3], [0, 0, (1 << 30) - 92], c.tolist(), [3, 5, (1 << 30) + 92]]


def test_links_of_a_pair_that_several_groups_gave_count_once():
    rng = np.random.default_rng(8)
    sizes = np.array([3000, 0, 5, 40_000, 1, 0])
    place, lead = rng.integers(-40, 40, (2, sizes.sum()))
    begin, p, q = passages.distinct_links(sizes, place, lead)
    edge = np.append(0, np.cumsum(sizes))
    assert len(begin) == len(sizes) + 1 and begin[-1] == len(p) == len(q)
    for n in range(len(sizes)):
        want = set(zip(place[edge[n] : edge[n + 1]].tolist(), lead[edge[n] : edge[n + 1]].tolist(), strict=True))
        assert list(zip(p[begin[n] : begin[n + 1]].tolist(), q[begin[n] : begin[n + 1]].tolist(), strict=True)) == sorted(want)
    assert [len(x) for x in passages.distinct_links(sizes[:0], place[:0], lead[:0])] == [1, 0, 0]


def test_words_are_counted_as_spark_counts_them(spark):
    texts = ["", " ", "a", " a", "a ", "\x0bé\x1cü ñ o\t\n日本 語", "  ", "one two", "three", "", "x\x00y\x0c\x0cz ", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    want = rows.selectExpr("id", r"cast(regexp_count(text, '[^\\x20\\x09-\\x0D]+') as long) AS words")
    got = rows.mapInArrow(passages.count_words, "id long, words long")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.where("id >= 100").count() == 0
    assert passages.word_counts([]).tolist() == [] and passages.word_counts([b"", b""]).tolist() == [0, 0]


def test_windows_of_equal_contents_have_equal_finer_keys():
    rng = np.random.default_rng(11)
    least, far = 6, 40
    tokens = rng.integers(0, 3, 4000).astype(np.uint64)
    sums = passages.token_sums(tokens)
    where = np.arange(far, len(tokens) - far)
    left, right = rng.integers(0, 12, (2, len(where)))
    got = passages.contents(sums, where, left, right, least).tolist()
    seen = {}
    for p, a, b, h in zip(where.tolist(), np.minimum(left, least - 1).tolist(), np.minimum(right, least - 1).tolist(), got, strict=True):
        seen.setdefault(h, set()).add((a, *tokens[p - a : p + b + 1].tolist()))
    assert all(len(x) == 1 for x in seen.values()) and len(seen) < len(where)
    key = np.zeros(len(where), np.uint64)
    finer = {}
    for n, k in passages.finer_keys(tokens, where, left, right, key, least, [5, 6]):
        for i, x in zip(n.tolist(), k.tolist(), strict=True):
            finer.setdefault(i, []).append(x)
    assert len({(h, tuple(sorted(finer.get(i, ())))) for i, h in enumerate(got)}) == len(seen)


@pytest.mark.parametrize("batch", [1, 3, 1000])
@pytest.mark.parametrize("held", [2, 1 << 16])
def test_windows_with_the_contents_of_their_first_are_not_dealt_out_again(batch, held):
    rows = [(1, 1, 10, 7), (1, 1, 30, 7), (1, 2, 10, 7), (1, 3, 10, 8), (1, 4, 10, 7), (2, 5, 1, 3), (2, 6, 1, 3), (3, 7, 1, 4)]
    cols = np.array(rows).T
    batches = [
        passages.pa.RecordBatch.from_arrays([*(passages.pa.array(c[i : i + batch]) for c in cols[:3]), passages.pa.array(cols[3, i : i + batch].astype(np.int32))], names=["key", "id", "place", "contents"])
        for i in range(0, len(rows), batch)
    ]
    got = [tuple(r.values()) for b in passages.lead_links(batches, held) for r in b.to_pylist()]
    want = [(1, 1, 10, 1, 10, True), (1, 1, 30, 1, 10, False), (1, 2, 10, 1, 10, False), (1, 3, 10, 1, 10, True), (1, 4, 10, 1, 10, False), (2, 5, 1, 5, 1, False), (2, 6, 1, 5, 1, False)]
    assert got == want
    assert list(passages.lead_links([])) == []
