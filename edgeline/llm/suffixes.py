"""Exact duplicate passages by suffix sorting with a difference cover.

A byte of a text goes if it is covered by a string of ``length`` bytes that also
starts in a document with a smaller id.

Suffixes are sorted by the difference-cover algorithm: triples at two of three
positions are sorted and named, the algorithm recurses on the names, the
remaining suffixes are sorted by their first byte and the following rank, and
both orders are merged (``suffix_order``). Neighbours in the order are compared
on their first ``length`` bytes, and runs of equal ones are the copies of a string.

The work is distributed by minimisers. Of the ``gram``-byte strings inside a
window of ``length`` bytes the one with the smallest hash is the window's
pivot, by the 40 high bits of the hash and the leftmost of equals; equal windows have equal pivots, so windows are dealt out by pivot and
equal ones meet. Pivots that occur in one document only are dropped before any
text moves, as their windows have no copy in another. Neighbouring windows with
one pivot travel as one string of at most 2 * length - gram bytes. A task sorts
the suffixes of such strings, pivots complete, about a megabyte at a time; equal
strings are sorted once, and strings of whose windows no other document has one
with the same hash are not sorted. A recursion deeper than ``length`` bytes is not needed.

Rows whose whole text a smaller id has too go whole and are left out of the
search (compared by SHA-256).

A pivot in more than ``hot`` documents would fill a task. Its windows are dealt
out one by one instead: the least id of each string is a pre-aggregated minimum.

Cases: ids are integers; null text is empty; rows with a null id neither lose
bytes nor make others lose any; rows of equal id do not affect each other; a
text shorter than ``length`` keeps all; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import _powers, col, keep, mix, slices


#: The low bits of a pivot's key that hold its place: fixed, so that the order of two strings depends on nothing else.
PLACES = np.uint64((1 << 24) - 1)
#: Numbers below it are sorted as they are; pairs and triples of larger ones are numbered first.
WHOLE = 1 << 62


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``s`` (numbers from 1) in order of at least their first ``depth`` numbers."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    ones, twos = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)
    cover = np.concatenate([ones, twos])
    wide = int(t.max()) + 1
    pair = t[:-1] * wide + t[1:]
    begin = pair[cover] if wide**3 < WHOLE else np.unique(pair[cover], return_inverse=True)[1]
    key, name = np.unique(begin * wide + t[cover + 2], return_inverse=True)
    if len(key) < len(cover) and depth > 3:
        name = name + 1
        # suffixes starting at ones come before those at twos; a zero triple ends the first half
        order = suffix_order(name, -(-depth // 3))
        rank = np.empty(len(cover), np.int64)
        rank[order] = np.arange(1, len(cover) + 1)
    else:
        order = np.argsort(name)
        rank = name + 1
    at = np.zeros(n + 3, np.int64)
    at[cover] = rank
    cover = cover[order]
    cover = cover[cover < n]
    zeros = np.arange(0, n, 3)
    many = int(at.max()) + 1
    zeros = zeros[np.argsort(t[zeros] * many + at[zeros + 1])]
    # a zero against a one: first number, then the ranks behind; against a two: two numbers, then the ranks
    one, two = cover[cover % 3 == 1], cover[cover % 3 == 2]
    both = pair[np.concatenate([zeros, two])]
    if wide * wide * many >= WHOLE:
        both = np.unique(both, return_inverse=True)[1]
    zero_two = both[: len(zeros)] * many + at[zeros + 2]
    two_two = both[len(zeros) :] * many + at[two + 2]
    behind = np.searchsorted(t[one] * many + at[one + 1], t[zeros] * many + at[zeros + 1])
    # suffixes equal to the depth may stand in any order, so a count may step back among them: it must not
    behind = np.maximum.accumulate(behind + np.searchsorted(two_two, zero_two)) + np.arange(len(zeros))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    out[behind] = zeros
    free[behind] = False
    out[free] = cover
    return out


def grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])


class Pivots:
    """Runs of neighbouring windows with one pivot: text number, first window, windows, the pivot's hash."""

    def __init__(self, texts: list[bytes], length: int, gram: int, at_once: int = 1 << 16):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        empty = np.empty(0, np.int64)
        self.doc, self.start, self.windows, self.hash = empty, empty, empty, empty.view(np.uint64)
        parts = [self._runs(raw[lo : lo + at_once + length - 1], lo, offsets, length, gram) for lo in range(0, len(raw) - length + 1, at_once)]
        if parts:
            self.doc, self.start, self.windows, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _runs(raw: np.ndarray, base: int, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """Of the windows of a stretch of less than 2^24 bytes that begins at ``base``."""
        n = len(raw) - length + 1
        h = grams(raw, gram)
        # the smallest by the 40 high bits, the leftmost of equals: the same in equal windows wherever they stand
        best = (h & ~PLACES) | np.arange(len(h), dtype=np.uint64)
        span, width = 1, length - gram + 1
        while span < width:
            step = min(span, width - span)
            best = np.minimum(best[:-step], best[step:])
            span += step
        pivot = (best & PLACES).astype(np.int64)[:n]
        # windows that lie in one text
        place = np.arange(base, base + n)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, base, base + n)))
        inside = place + length <= offsets[owner + 1]
        fresh = inside.copy()
        fresh[1:] &= (pivot[1:] != pivot[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
        start = np.flatnonzero(fresh)
        stop = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)) + 1
        doc = owner[start]
        return doc, start + base - offsets[doc], stop - start, h[pivot[start]]


def shared(joined: np.ndarray, begin: np.ndarray, lens: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """Which strings hold a window whose hash another owner's string has too; strings lie at ``begin`` of ``joined``."""
    string = np.repeat(np.arange(len(lens)), lens - length + 1)
    at = np.arange(len(string)) - np.repeat(np.cumsum(lens - length + 1) - (lens - length + 1), lens - length + 1) + begin[string]
    h = grams(joined, length)[at]
    order = np.argsort(h)
    h, string = h[order], string[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    met = np.minimum.reduceat(least[string], edge) < np.maximum.reduceat(most[string], edge)
    keep_ = np.zeros(len(lens), bool)
    keep_[string[np.repeat(met, np.diff(np.append(edge, len(h))))]] = True
    return keep_


def copies(text: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) pairs whose ``length`` bytes also occur in a string of a smaller owner."""
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    unique = {}
    which = np.fromiter((unique.setdefault(t, len(unique)) for t in text), np.int64, len(text))
    least = np.full(len(unique), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner)
    most = np.full(len(unique), np.iinfo(np.int64).min)
    np.maximum.at(most, which, owner)
    lens = np.fromiter(map(len, unique), np.int64, len(unique))
    begin = np.cumsum(lens) - lens
    # most strings share a pivot with others and no window: only those that may share one are sorted
    stay = shared(np.frombuffer(b"".join(unique), np.uint8), begin, lens, least, most, length)
    if not stay.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.cumsum(stay) - 1
    there = np.flatnonzero(stay[which])
    which, owner, least, lens, sizes = place[which[there]], owner[there], least[stay], lens[stay], sizes[there]
    joined = b"\0".join([t for t, k in zip(unique, stay.tolist(), strict=True) if k]) + b"\0" * 8
    begin = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    raw = np.frombuffer(joined, np.uint8)
    order = suffix_order(raw[: begin[-1] + lens[-1]].astype(np.int64) + 1, length)
    string = np.repeat(np.arange(len(lens)), lens + 1)[: begin[-1] + lens[-1]]
    inside = np.arange(len(string)) + length <= (begin + lens)[string]
    order = order[inside[order]]
    # eight bytes at a time: neighbours in the order are equal on their first bytes
    word = np.zeros(len(raw) - 7, np.uint64)
    for j in range(8):
        word |= raw[j : len(raw) - 7 + j].astype(np.uint64) << np.uint64(8 * j)
    same = np.ones(max(0, len(order) - 1), bool)
    for j in [*range(0, length - 7, 8), max(0, length - 8)]:
        w = word[order + j]
        same &= w[1:] == w[:-1]
    head = np.append(True, ~same) if len(order) else np.empty(0, bool)
    smallest = np.full(len(string), np.iinfo(np.int64).max)
    if len(order):
        group = np.cumsum(head) - 1
        smallest[order] = np.minimum.reduceat(least[string[order]], np.flatnonzero(head))[group]
    windows = np.maximum(sizes - length + 1, 0)
    item = np.repeat(np.arange(len(there)), windows)
    at = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = smallest[begin[which[item]] + at] < owner[item]
    return there[item[hit]], at[hit]


def equal_texts(docs: DataFrame) -> DataFrame:
    """(id, shas): digests of the whole texts of an id that a smaller id has too."""
    named = docs.select("id", F.sha2("text", 256).alias("sha"))
    least = named.groupBy("sha").agg(F.min("id").alias("first"))
    return named.join(least, "sha").where("first < id").groupBy("id").agg(F.collect_set("sha").alias("shas"))


def spans_of(docs: DataFrame, length: int = 50, gram: int = 24, hot: int = 50_000, held: int = 1 << 20) -> DataFrame:
    """docs(id, text as bytes, copy, key) -> (id, spans): the byte ranges [lo, hi) that go, unmerged.

    ``key`` tells texts of one id apart; a range names the key of its text.

    A text that a smaller id has too goes whole, and no other text loses more
    for it: such rows, marked ``copy``, take no part in the search.
    """
    if not 8 <= gram <= length:
        raise ValueError("a gram has from 8 bytes to the window's length")

    def occur(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [b"" if c else t or b"" for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            for lo, hi in slices(texts, 1 << 20):
                p = Pivots(texts[lo:hi], length, gram)
                order = np.lexsort((p.doc, p.hash))
                h, d = p.hash[order], p.doc[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[fresh].view(np.int64)), pa.array(ids[lo + d[fresh]])], names=["pivot", "id"])

    # dealt out once, for the counts and for the join: a row is 16 bytes, one for each text and pivot of some megabytes
    found = docs.mapInArrow(occur, "pivot long, id long").repartition("pivot")
    shared = found.groupBy("pivot").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    wanted = found.join(shared.select("pivot", (F.col("n") > hot).alias("hot")), "pivot")
    # dealt out as plain rows: lists gathered by map tasks would hold one pivot each
    wanted = wanted.select("id", "hot", "pivot").repartition("id")
    wanted = keep(wanted.groupBy("id", "hot").agg(F.collect_set("pivot").alias("pivots")), "pivots", drop_shuffles=True)

    def strings(single: bool):
        def run(batches):
            for b in batches:
                ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
                copy, keys, pivots = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
                for lo, hi in slices(texts, 1 << 20):
                    p = Pivots(texts[lo:hi], length, gram)
                    edge = np.searchsorted(p.doc, np.arange(hi - lo + 1))
                    out = [], [], [], [], []
                    for d in range(hi - lo):
                        if copy[lo + d] or not pivots[lo + d].is_valid:
                            continue
                        # a string that a text repeats travels once, with all its places
                        places: dict[tuple[int, bytes], list[int]] = {}
                        mine = slice(edge[d], edge[d + 1])
                        take = np.flatnonzero(np.isin(p.hash[mine], pivots[lo + d].values.to_numpy().view(np.uint64))) + edge[d]
                        t = texts[lo + d]
                        for h, s, w in zip(p.hash[take].view(np.int64).tolist(), p.start[take].tolist(), p.windows[take].tolist(), strict=True):
                            for a, size in [(s + i, length) for i in range(w)] if single else [(s, w + length - 1)]:
                                places.setdefault((h, t[a : a + size]), []).append(a)
                        out[0].extend(h for h, _ in places)
                        out[1].extend([ids[lo + d]] * len(places))
                        out[2].extend([keys[lo + d]] * len(places))
                        out[3].extend(places.values())
                        out[4].extend(x for _, x in places)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["pivot", "id", "key", "at", "bytes"])

        return run

    def find(batches):
        def solve(parts):
            owner, key = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            item, window = copies([t for p in parts for t in p[4]], owner, length)
            head = np.ones(len(item), bool)
            head[1:] = (item[1:] != item[:-1]) | (window[1:] != window[:-1] + 1)
            first, last = np.flatnonzero(head), np.flatnonzero(np.append(head[1:], True)) if len(head) else np.empty(0, np.int64)
            places = [a for p in parts for a in p[3]]
            run = item[first]
            times = np.array([len(places[i]) for i in run], np.int64)
            base = np.array([a for i in run for a in places[i]], np.int64)
            begin, end = np.repeat(window[first], times), np.repeat(window[last], times)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(owner[run], times)), pa.array(np.repeat(key[run], times)), pa.array(base + begin), pa.array(base + end + length)],
                names=["id", "key", "lo", "hi"],
            )

        parts, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] + [b.column(i).to_pylist() for i in (3, 4)]
            # what stands before the last pivot of this batch is complete
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if parts and parts[-1][0][-1] != cols[0][0] and size >= held:
                yield solve(parts)
                parts, size = [], 0
            if size + sum(map(len, cols[4][:cut])) >= held and cut:
                yield solve([*parts, [c[:cut] for c in cols]])
                parts, size = [], 0
                cols = [c[cut:] for c in cols]
            parts.append(cols)
            size += sum(map(len, cols[4]))
        if parts:
            yield solve(parts)

    def texts_with(hot_ones: bool) -> DataFrame:
        mine = wanted.where(F.col("hot") if hot_ones else ~F.col("hot")).select("id", "pivots")
        return docs.join(mine, "id", "left").mapInArrow(strings(hot_ones), "pivot long, id long, key long, at array<long>, bytes binary")

    spans = texts_with(False).repartition("pivot").sortWithinPartitions("pivot").mapInArrow(find, "id long, key long, lo long, hi long")
    if not wanted.where("hot").isEmpty():
        single = keep(texts_with(True).select("bytes", "id", "key", "at"), "windows", drop_shuffles=True)
        least = single.groupBy("bytes").agg(F.min("id").alias("least"))
        more = single.join(least, "bytes").where("least < id").select("id", "key", F.explode("at").alias("lo"))
        spans = spans.union(more.select("id", "key", "lo", (F.col("lo") + length).alias("hi")))
    return spans.groupBy("id").agg(F.collect_set(F.struct("key", "lo", "hi")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Ranges that touch or overlap as one."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(s) for s in out]


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("binary").alias("text"))
    return rows.repartition("id")  # dealt out once: the plan below uses it twice


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, **options) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): of every row the merged ranges that go, and the bytes that stay."""
    named = docs.where(col(id_col).isNotNull())
    rows = _dealt(named, id_col, text_col)
    texts = named.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    copy = F.when(F.col("shas").isNotNull(), F.array_contains("shas", F.sha2(F.coalesce("text", F.lit(b"")), 256)))
    marked = rows.join(equal_texts(texts), "id", "left").select("id", "text", F.coalesce(copy, F.lit(False)).alias("copy"), F.xxhash64("text").alias("key"))
    nameless = docs.where(col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("id"), col(text_col).cast("binary").alias("text"), F.lit(None).cast("array<struct<key:bigint,lo:bigint,hi:bigint>>").alias("spans")
    )
    out = marked.join(spans_of(marked, length, **options), "id", "left")
    size = F.octet_length("text").cast("long")
    whole = F.array(F.struct(F.col("key"), F.lit(0).cast("long").alias("lo"), size.alias("hi")))
    mine = F.filter("spans", lambda x: x["key"] == F.col("key"))
    mine = F.when(F.col("copy") & (size >= length), whole).otherwise(mine)
    out = out.select("id", "text", mine.alias("spans")).union(nameless)

    def run(batches):
        for b in batches:
            n, gone, spans, kept = [], [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, ranges, at, rest = text or b"", merged(found), 0, []
                for lo, hi in ranges:
                    rest.append(text[at:lo])
                    at = hi
                rest.append(text[at:])
                n.append(len(text))
                gone.append(sum(hi - lo for lo, hi in ranges))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in ranges])
                kept.append(b"".join(rest))
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return out.mapInArrow(run, "id long, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary")
