"""Near-duplicate passages by compact windows.

Tokens are shingles of ``shingle`` neighbouring words, A-Z lowered. For each of
``hashes`` hash functions, all subsequences of a text of at least ``least``
tokens whose smallest hash stands at position c are one compact window
(l, c, r): those that begin in [l, c] and end in [c, r]. A text's windows are the
upper nodes of the Cartesian tree over its token hashes; a position is one if it
is smallest in some stretch of ``least`` tokens, and its nearest smaller
positions on both sides, themselves windows, bound it.

Windows of different documents with the same hash function and smallest hash
form a group and are linked to the group's first document (smallest id), so a
group of any size gives a link each. Windows are dealt out and sorted by key once
and the groups are read as they come: a group holds one row in memory. A first document that merely holds the
smallest token shares no passage with the others, so groups of more than two
windows are dealt out again by key and the smallest hash among the ``least`` - 1
tokens on one side of c, within the window, for both sides and ``hashes`` further
functions; each of these finer groups is linked to its own first document. A window
with the tokens of its group's first one on both sides is in that one's finer groups,
whose links are known, and is not dealt out again: windows travel with a hash of these
tokens, of 32 bits. A window
travels once, by its group's key and with its finer keys, and gives each link once,
and none that its group has given: one task reads all finer groups of a group and
holds the first window of each, up to a bound; finer groups beyond it are dealt
out by their own keys. A text
that equals an earlier one is linked to the first of its kind. Per document and first document the linked
windows are joined as intervals: windows that overlap in both texts on nearby
diagonals form a candidate if at least ``agree`` hash functions take part. The
tokens of both candidates are then compared: the longest ranges of at least
``least`` tokens that begin and end with common tokens in the same order and
whose Jaccard similarity is ``similarity`` or more are passages, whatever the
gaps inside. Equal texts are equal passages.

Cases: ids are integers; null text is empty; a text of fewer tokens has no
passage; rows with a null id take no part; rows of one id are one document, each
of its texts is searched and none is compared with the others; an empty table gives an empty result; other columns are kept by ``drop_passages``
and ignored by ``passages``.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from edgeline.llm.common import Words, _powers, col, free, keep, lean, mix, slices, utf8, word_counts

SEED = 0xA0761D6478BD642F
#: A window as one number: c, then how far it reaches to the left and to the right, then the hash function.
REACH, SIDE = (1 << 14) - 1, 14
LINK = ["id", "lead", "place", "lead_place"]


def compact_windows(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, l, c, r) of all compact windows of at least ``least`` tokens; text d has the tokens first[d] to first[d + 1]."""
    none = np.empty(0, np.int64)
    n = len(values)
    if n < least:
        return none, none, none, none
    low = np.uint64((1 << n.bit_length()) - 1)
    best = (values & ~low) | np.arange(n, dtype=np.uint64)
    ranked = best
    span = 1
    while span < least:
        step = min(span, least - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    sizes = np.diff(first)
    end = np.repeat(first[1:], sizes)
    best = best[np.arange(len(best)) + least <= end[: len(best)]]
    c = np.unique((best & low).astype(np.int64))
    text = np.searchsorted(first, c, "right") - 1
    l, r = first[text].copy(), first[text + 1] - 1
    value, place, owner = ranked[c].tolist(), c.tolist(), text.tolist()
    left, right, stack, now = l.tolist(), r.tolist(), [], -1
    for i, v in enumerate(value):
        if owner[i] != now:
            stack, now = [], owner[i]
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[i] - 1
        if stack:
            left[i] = place[stack[-1]] + 1
        stack.append(i)
    base = first[text]
    return text, np.array(left) - base, c - base, np.array(right) - base


def chains(items: list[tuple[int, ...]], least: int, agree: int) -> list[tuple[int, int, int, int]]:
    """Candidate ranges (lo, hi, lead lo, lead hi), ends excluded, of linked windows (hash function, l, c, r, ll, lc, lr)."""
    open_: list[list] = []
    done = []
    for k, l, c, r, ll, lc, lr in sorted(items, key=lambda x: (x[2], x[5])):
        still = []
        home = None
        for ch in open_:
            if c - ch[1] > least:
                done.append(ch)
                continue
            still.append(ch)
            if home is None and abs(lc - ch[2]) <= least and l <= ch[4] and ll <= ch[6]:
                home = ch
        open_ = still
        if home is None:
            open_.append([{k}, c, lc, l, r, ll, lr, c, lc])
            continue
        home[0].add(k)
        home[1], home[2] = c, lc
        home[3], home[4] = min(home[3], l), max(home[4], r)
        home[5], home[6] = min(home[5], ll), max(home[6], lr)
        home[8] = min(home[8], lc)
    out = []
    for ks, c, lc, l, r, ll, lr, c0, lc0 in done + open_:
        if len(ks) >= agree:
            # as far as the windows reach, and no further than a passage can without another window
            out.append((max(l, c0 - 2 * least), min(r, c + 2 * least) + 1, max(ll, lc0 - 2 * least), min(lr, lc + 2 * least) + 1))
    return out


def compare(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages (lo, hi, other lo, other hi, similarity) of the tokens a that are near-duplicates of tokens of b.

    Common tokens in the same order are linked. From link i to link j there are j - i + 1
    common tokens, so the similarity is reached if f(j) - f(i) >= 2t - 1 for f = link number
    - t * (place in a + place in b) and t = similarity / (1 + similarity): for each link the
    last such j is looked up, and of these ranges the fewest that hold all others' links are
    judged by their sets of tokens. A range that repeated tokens pull under the similarity
    gives up links at its ends until it is reached.
    """
    if not len(a) or not len(b):
        return []
    x, y = links(a, b)
    if not len(x):
        return []
    t = similarity / (1 + similarity)
    f = np.arange(len(x)) - t * (x + y)
    later = np.maximum.accumulate(f[::-1])  # ascending; the last place of a value at least as large is found from the end
    last = len(f) - 1 - np.searchsorted(later, f + (2 * t - 1) - 1e-9)
    out = []
    for i, j in cover(x, last, least):
        got = judge(a, b, x, y, i, j, least, similarity)
        if got:
            out.append(got)
    return out


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of common tokens, both ascending: a longest chain of them, where a token that b repeats may stand for any."""
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    lo, hi = np.searchsorted(ranked, a), np.searchsorted(ranked, a, "right")
    there = np.flatnonzero(hi > lo)
    if not len(there):
        return there, there
    y = order[lo[there]]
    if (hi - lo)[there].max() == 1 and (np.diff(y) > 0).all():
        return there, y
    # of a repeated token the place nearest to the diagonal of the last token that stands alone
    single = (hi - lo)[there] == 1
    shift = int(np.median((y - there)[single])) if single.any() else 0
    px, py = there.tolist(), []
    for p, alone in zip(px, single.tolist(), strict=True):
        if alone:
            q = int(order[lo[p]])
            shift = q - p
        else:
            places = order[lo[p] : hi[p]]
            k = int(np.searchsorted(places, p + shift))
            near = places[max(k - 1, 0) : k + 1]
            q = int(near[np.argmin(np.abs(near - p - shift))])
        py.append(q)
    # the longest ascending chain
    tails: list[int] = []
    at: list[int] = []
    back = []
    for n, q in enumerate(py):
        k = bisect_left(tails, q)
        if k == len(tails):
            tails.append(q)
            at.append(n)
        else:
            tails[k], at[k] = q, n
        back.append(at[k - 1] if k else -1)
    chain, n = [], at[-1]
    while n >= 0:
        chain.append(n)
        n = back[n]
    chain.reverse()
    return np.array(px)[chain], np.array(py)[chain]


def cover(x: np.ndarray, last: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The fewest ranges (i, last[i]) of at least ``least`` tokens of a that together hold every link of such a range."""
    starts = np.flatnonzero((last >= np.arange(len(x))) & (x[np.maximum(last, 0)] - x + 1 >= least))
    out: list[tuple[int, int]] = []
    best = None
    for i in starts.tolist():
        j = int(last[i])
        if best is not None and i > (out[-1][1] if out else -1) + 1 and best[1] > (out[-1][1] if out else -1):
            out.append(best)
            best = None
        if best is None or j > best[1]:
            best = (i, j)
    if best is not None and best[1] > (out[-1][1] if out else -1):
        out.append(best)
    return out


def judge(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, i: int, j: int, least: int, similarity: float):
    """The passage from link i to j, or what is left of it when links at its ends are given up until it is similar."""

    def score(i: int, j: int) -> float:
        one, two = np.unique(a[x[i] : x[j] + 1]), np.unique(b[y[i] : y[j] + 1])
        common = len(np.intersect1d(one, two, assume_unique=True))
        return common / (len(one) + len(two) - common)

    now = score(i, j)
    while now < similarity:
        if i >= j or x[j] - x[i] + 1 < least:
            return None
        left, right = score(i + 1, j), score(i, j - 1)
        i, j, now = (i + 1, j, left) if left >= right else (i, j - 1, right)
    if x[j] - x[i] + 1 < least:
        return None
    return int(x[i]), int(x[j]) + 1, int(y[i]), int(y[j]) + 1, now


def finer_keys(tokens: np.ndarray, where: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray, least: int, seeds: list[int]):
    """(window, key) of the finer groups of windows at ``where``: with the smallest hash on one side, within ``least`` tokens, by each seed."""
    step = np.arange(1, least)
    for s, seed in enumerate(seeds):
        v = mix(tokens ^ np.uint64(seed))
        for side, room in enumerate((left, right)):
            for lo in range(0, len(where), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                at = where[part, None] + (step if side else -step)
                inside = step <= room[part, None]
                smallest = np.where(inside, v[np.where(inside, at, 0)], np.uint64((1 << 64) - 1)).min(axis=1, initial=(1 << 64) - 1)
                n = np.flatnonzero(room[part] > 0)
                yield lo + n, mix(key[part][n] ^ mix(smallest[n] + np.uint64(2 * s + side)))


def token_sums(tokens: np.ndarray) -> np.ndarray:
    """What ``contents`` needs of the tokens of some texts."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _powers(len(tokens))[0][: len(tokens)], out=sums[1:])
    return sums


def contents(sums: np.ndarray, where: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """A hash of the tokens that ``finer_keys`` looks at, so windows of a group with equal ones have equal finer keys."""
    left, right = np.minimum(left, least - 1), np.minimum(right, least - 1)
    span = (sums[where + right + 1] - sums[where - left]) * _powers(len(sums))[1][where - left]
    return (mix(span ^ mix((left * least + right).astype(np.uint64))) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def packed(c: np.ndarray, left: np.ndarray, right: np.ndarray, k: np.ndarray | int, most: int) -> np.ndarray:
    """Windows as numbers that sort by c. A reach beyond ``most`` is cut to it, as no candidate extends further."""
    return (c << 32) | (np.minimum(left, most) << (4 + SIDE)) | (np.minimum(right, most) << 4) | k


def unpacked(place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k, l, c, r) of packed windows."""
    c = place >> 32
    return place & 15, c - ((place >> (4 + SIDE)) & REACH), c, c + ((place >> 4) & REACH)


def marked(place: np.ndarray) -> np.ndarray:
    """Places as negative numbers, which sort before all others; of such numbers the places."""
    return ~place


def lead_links(batches, held: int = 1 << 16):
    """Of rows (key, id, place) in this order: those of keys with several ids, each with its key's first row; ``many``: over two rows.

    A key's rows go out as they come, so one that very many rows have is never gathered.
    With a fourth column, ``contents``, rows that have their key's first row's are not ``many``, but for that row.
    Keys whose first row has a ``marked`` place are left out: their links are known.
    """
    rest = None
    going = None  # the key, first id and place of a group whose beginning went out

    def out(x: np.ndarray, first: np.ndarray, many: np.ndarray):
        names = ["key", "id", "place", "lead", "lead_place", "many"]
        x[2] = np.maximum(x[2], marked(x[2]))
        if len(x) > 3:
            many = many & ((x[3] != first[2]) | ((x[1] == first[0]) & (x[2] == first[1])))
        return pa.RecordBatch.from_arrays([*(pa.array(v) for v in x[:3]), pa.array(first[0]), pa.array(first[1]), pa.array(many)], names=names)

    def groups(x: np.ndarray):
        """Complete groups."""
        edge = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
        size = np.diff(np.append(edge, x.shape[1]))
        several = (x[1, edge] != x[1, edge + size - 1]) & (x[2, edge] >= 0)
        row = np.repeat(several, size)
        return out(x[:, row], np.repeat(x[1:, edge[several]], size[several], axis=1), np.repeat(size[several] > 2, size[several]))

    for b in _and_end(batches):
        if b is not None:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            x = x if rest is None else np.concatenate([rest, x], axis=1)
        elif rest is None:
            return
        else:
            x = rest
        rest = x[:, :0]
        if going is not None and x.shape[1]:
            n = int(np.searchsorted(x[0], going[0], "right")) if x[0, 0] == going[0] else 0
            if n and going[2] >= 0:
                yield out(x[:, :n], np.repeat(going[1:, None], n, axis=1), np.ones(n, bool))
            x = x[:, n:]
        if not x.shape[1]:
            continue
        if b is not None:
            cut = int(np.searchsorted(x[0], x[0, -1]))
            rest, x = x[:, cut:], x[:, :cut]
            going = None
        if x.shape[1]:
            yield groups(x)
        if rest.shape[1] > max(held, 2) and rest[1, 0] != rest[1, -1]:
            going = rest[:, 0].copy()
            if going[2] >= 0:
                yield out(rest, np.repeat(going[1:, None], rest.shape[1], axis=1), np.ones(rest.shape[1], bool))
            rest = rest[:, :0]


def _and_end(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def links_within(batches, held: int = 1 << 19):
    """Of rows (key, id, place, finer keys) in order of the first three: links to the first row of each finer key, as (id, lead, items) with items (place, lead_place).

    Links to a ``marked`` row, the first of its key, are known and left out. Of a key
    with over ``held`` finer keys, those met later come back as rows (id, place, finer).
    Links of one pair go out together, as far as ``held`` links are kept back.
    """
    kept, count = [], 0

    def out(links: np.ndarray, apart: np.ndarray):
        i, lead, place, lead_place = np.unique(links, axis=1)
        edge = np.append(np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (lead[1:] != lead[:-1])])[: len(i)]), len(i))
        n = apart.shape[1]
        items = pa.StructArray.from_arrays([pa.array(place), pa.array(lead_place)], names=["place", "lead_place"])
        edges = pa.array(np.append(edge, np.full(n, len(i))).astype(np.int32))
        cols = [(i[edge[:-1]], apart[0]), (pa.array(lead[edge[:-1]]), pa.nulls(n, pa.int64())), (pa.nulls(len(edge) - 1, pa.int64()), apart[1]), (pa.nulls(len(edge) - 1, pa.int64()), apart[2])]
        cols = [pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())]) for x, y in cols]
        return pa.RecordBatch.from_arrays([*cols[:2], pa.ListArray.from_arrays(edges, items), *cols[2:]], names=["id", "lead", "items", "place", "finer"])

    none = np.empty(0, np.int64)
    now, seen, full = None, (none, none, none), False  # finer keys of the last key, ascending, with the id and place of their first rows
    for b in batches:
        if not b.num_rows:
            continue
        key, ids, place = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
        finer = b.column(3).flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(key)), b.column(3).value_lengths().to_numpy(zero_copy_only=False))
        order = np.argsort(finer, kind="stable")
        finer, row = finer[order], row[order]
        head = np.flatnonzero(np.concatenate([[True], finer[1:] != finer[:-1]])[: len(finer)])
        size = np.diff(np.append(head, len(row)))
        kinds, lead, lead_place = finer[head], ids[row[head]], place[row[head]]
        at = np.searchsorted(seen[0], kinds)
        if len(seen[0]):
            known = seen[0][np.minimum(at, len(seen[0]) - 1)] == kinds
            lead, lead_place = lead.copy(), lead_place.copy()
            lead[known], lead_place[known] = seen[1][at[known]], seen[2][at[known]]
        else:
            known = np.zeros(len(kinds), bool)
        late = ~known & (key[row[head]] == now) if full else np.zeros(len(kinds), bool)
        which = np.repeat(np.arange(len(kinds)), size)
        fresh = ~late[which] & (ids[row] != lead[which]) & (lead_place[which] >= 0)
        row_place = np.maximum(place, marked(place))
        links = np.stack([ids[row[fresh]], lead[which[fresh]], row_place[row[fresh]], lead_place[which[fresh]]])
        kept.append(np.unique(links, axis=1))
        count += kept[-1].shape[1]
        apart = late[which]
        if count > held or apart.any():
            yield out(np.concatenate(kept, axis=1), np.stack([ids[row[apart]], place[row[apart]], finer[apart]]))
            kept, count = [], 0
        if key[-1] != now:
            now, full = key[-1], False
            seen, at = (none, none, none), np.zeros(len(kinds), np.int64)
        if not full:
            new = ~known & (key[row[head]] == now)
            seen = tuple(np.insert(x, at[new], v[new]) for x, v in zip(seen, (kinds, lead, lead_place), strict=True))
            full = len(seen[0]) > held
    if kept:
        yield out(np.concatenate(kept, axis=1), np.empty((3, 0), np.int64))


def distinct_links(sizes: np.ndarray, place: np.ndarray, lead_place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins of the pairs, place, lead_place) of the links of some pairs, ``sizes`` each: copies come from several groups, one is kept."""
    pair = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((lead_place, place, pair))
    pair, place, lead_place = pair[order], place[order], lead_place[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1]) | (lead_place[1:] != lead_place[:-1])
    return np.searchsorted(pair[fresh], np.arange(len(sizes) + 1)), place[fresh], lead_place[fresh]


LEADS = "key long, id long, place long, lead long, lead_place long, many boolean"


def linked_to_leads(windows: DataFrame) -> DataFrame:
    """``lead_links`` of (key, id, place[, contents]), dealt out once by key."""
    return windows.repartition("key").sortWithinPartitions("key", "id", "place").mapInArrow(lean(lead_links), LEADS)


def count_words(batches):
    """(id, words) of rows (id, text)."""
    for b in batches:
        texts = utf8(b.column(1))
        n = [word_counts(texts[lo:hi]) for lo, hi in slices(texts)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n) if n else [], pa.int64())], names=["id", "words"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(rows (id, text), names (id, text_key[, own]), whether ids stand for texts).

    Where no id has several texts an id stands for its text. Otherwise texts get
    numbers of their own in the order of (id, text hash), ``own`` being the id.
    """
    rows = docs.where(col(id_col).isNotNull()).select(
        col(id_col).cast("long").alias("id"), F.xxhash64(col(text_col)).alias("text_key"), F.coalesce(col(text_col), F.lit("")).alias("text")
    )
    names = keep(rows.select("id", "text_key").distinct(), "names", drop_shuffles=True)
    if names.groupBy("id").count().where("count > 1").isEmpty():
        return rows.select("id", "text"), names, True
    order = names.repartitionByRange("id", "text_key").sortWithinPartitions("id", "text_key")
    order = order.select(F.col("id").alias("own"), "text_key", F.monotonically_increasing_id().alias("number"))
    order = keep(order, "numbers", drop_shuffles=True)
    rows = rows.withColumnRenamed("id", "own").join(order, ["own", "text_key"]).select(F.col("number").alias("id"), "text")
    return rows, order.withColumnRenamed("number", "id"), False


def _passages(docs: DataFrame, id_col: str, text_col: str, min_words: int, shingle: int, similarity: float, hashes: int, agree: int) -> tuple[DataFrame, DataFrame, bool]:
    """The passages, with texts numbered as ``_numbered`` says, and its names."""
    least, held = min_words - shingle + 1, 20_000
    if not 0 < 2 * least <= REACH or not 0 < hashes < 16:
        raise ValueError(f"passages of up to {REACH // 2} tokens and up to 15 hash functions")
    rows, names, plain = _numbered(docs, id_col, text_col)
    seeds = [int(x) for x in mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(SEED))]

    def windows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = utf8(batch.column(1))
            for lo, hi in slices(texts, 1 << 18):
                w = Words(texts[lo:hi])
                tokens, at = w.shingles(shingle)
                first = np.searchsorted(w.doc[at], np.arange(hi - lo + 1))
                sums = token_sums(tokens)
                for k, seed in enumerate(seeds):
                    v = mix(tokens ^ np.uint64(seed))
                    d, l, c, r = compact_windows(v, first, least)
                    place, where = packed(c, c - l, r - c, k, 2 * least), first[d] + c
                    cols = v[where].view(np.int64), ids[lo + d], place, contents(sums, where, c - l, r - c, least)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "id", "place", "contents"])

    found = rows.mapInArrow(lean(windows), "key long, id long, place long, contents int")
    shared = keep(linked_to_leads(found), "windows", drop_shuffles=True)

    # groups of more than two windows again, in finer groups; of equal texts the first stands for all
    firsts = names.groupBy("text_key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    same = keep(names.join(firsts, "text_key").where("id != lead").select("id", "lead"), "same", drop_shuffles=True)
    again = shared.where("many").join(same.select("id"), "id", "left_anti")
    first_of_all = (F.col("id") == F.col("lead")) & (F.col("place") == F.col("lead_place"))
    window = F.struct("key", "place", first_of_all.alias("first"))
    finer_seeds = [int(x) for x in mix(np.arange(hashes + 1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(SEED))]

    def finer(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            sizes, flat = batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten()
            begin = np.concatenate([[0], np.cumsum(sizes)])
            key, place = flat.field("key").to_numpy(), flat.field("place").to_numpy()
            _, l, c, r = unpacked(place)
            place = np.where(flat.field("first").to_numpy(zero_copy_only=False), marked(place), place)
            for lo, hi in slices(texts, 1 << 18):
                w = Words(texts[lo:hi])
                tokens, at = w.shingles(shingle)
                first = np.searchsorted(w.doc[at], np.arange(hi - lo + 1))
                part = slice(begin[lo], begin[hi])
                d = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                args = first[d] + c[part], c[part] - l[part], r[part] - c[part], key[part].view(np.uint64)
                found = list(finer_keys(tokens, *args, least, finer_seeds))
                which, keys = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
                order = np.argsort(which, kind="stable")
                edge = np.searchsorted(which[order], np.arange(len(d) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(keys[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(ids[lo + d]), pa.array(place[part]), lists], names=["key", "id", "place", "finer"])

    mine = again.groupBy("id").agg(F.collect_list(window).alias("windows"))
    fine = rows.join(mine, "id").mapInArrow(lean(finer), "key long, id long, place long, finer array<long>")
    fine = fine.repartition("key").sortWithinPartitions("key", "id", "place")
    fine = fine.mapInArrow(lean(links_within), "id long, lead long, items array<struct<place:long,lead_place:long>>, place long, finer long")
    fine = keep(fine, "links", drop_shuffles=True)
    linked = shared.where("id != lead").select(LINK)
    apart = fine.where("finer IS NOT NULL").select(F.col("finer").alias("key"), "id", "place")
    if not apart.isEmpty():
        linked = linked.union(linked_to_leads(apart).where("id != lead").select(LINK))
    linked = linked.select("id", "lead", F.array(F.struct("place", "lead_place")).alias("items")).union(fine.where("finer IS NULL").select("id", "lead", "items"))
    linked = linked.groupBy("id", "lead").agg(F.flatten(F.collect_list("items")).alias("items"))
    if not plain:
        a, b = (names.select(F.col("id").alias(x), F.col("own").alias(f"own_{x}")) for x in ("id", "lead"))
        linked = linked.join(a, "id").join(b, "lead").where("own_id != own_lead")
    linked = linked.select("id", "lead", "items")

    def join_intervals(batches):
        for b in batches:
            sizes, flat = b.column(2).value_lengths().to_numpy(), b.column(2).flatten()
            edge = np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < b.num_rows:
                # some pairs at a time, as a pair may have very many links
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + 20_000, "right")) - 1)
                part = flat.slice(edge[lo], edge[hi] - edge[lo])
                begin, mine, other = distinct_links(sizes[lo:hi], *(part.field(x).to_numpy() for x in ("place", "lead_place")))
                items = list(zip(*(x.tolist() for x in (*unpacked(mine), *unpacked(other)[1:])), strict=True))
                out = [], [], [], [], [], []
                for n in range(lo, hi):
                    i, lead = b.column(0)[n].as_py(), b.column(1)[n].as_py()
                    for c in chains(items[begin[n - lo] : begin[n - lo + 1]], least, agree):
                        for column, v in zip(out, (i, *c[:2], lead, *c[2:]), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["id", "lo", "hi", "lead", "llo", "lhi"])
                lo = hi

    candidates = linked.mapInArrow(lean(join_intervals), "id long, lo long, hi long, lead long, llo long, lhi long")
    a, b = (names.select(F.col("id").alias(x), F.col("text_key").alias(k)) for x, k in (("id", "key_a"), ("lead", "key_b")))
    candidates = keep(candidates.join(a, "id").join(b, "lead"), "candidates", drop_shuffles=True)
    free(shared, fine)
    # equal texts need no comparison of tokens, other candidates do
    near = candidates.where("key_a != key_b").select("id", "lo", "hi", "lead", "llo", "lhi").distinct()
    near = keep(near.withColumn("pair", F.monotonically_increasing_id()), "near", drop_shuffles=True)
    equal = candidates.where("key_a = key_b").select("id", "lead").union(same).distinct()
    sides = [near.select(i, F.struct("pair", F.lit(n).alias("side"), F.col(lo).alias("lo"), F.col(hi).alias("hi")).alias("range")) for n, (i, lo, hi) in enumerate([("id", "lo", "hi"), ("lead", "llo", "lhi")])]
    sides = sides[0].union(sides[1])
    # the ranges of a text that very many others meet are dealt out over several rows
    busy = sides.groupBy("id").agg(F.ceil(F.count("*") / held).alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod("range.pair", "parts"), F.lit(0))
    asked = sides.join(busy, "id", "left").groupBy("id", part.alias("part")).agg(F.collect_list("range").alias("ranges")).drop("part")

    def cut(batches):
        for batch in batches:
            ids, texts, ranges = batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2)
            sizes, flat = ranges.value_lengths().to_numpy(), ranges.flatten()
            edge = np.concatenate([[0], np.cumsum(sizes)])
            pair, side, begin, end = (flat.field(x).to_numpy() for x in ("pair", "side", "lo", "hi"))
            for lo, hi in slices(texts, 1 << 18):
                w = Words(texts[lo:hi])
                tokens, at = w.shingles(shingle)
                first = np.searchsorted(w.doc[at], np.arange(hi - lo + 1))
                for some in range(edge[lo], edge[hi], 2048):
                    mine = np.arange(some, min(some + 2048, edge[hi]))
                    d = np.searchsorted(edge, mine, "right") - 1
                    cuts = [tokens[x:y].tobytes() for x, y in zip((first[d - lo] + begin[mine]).tolist(), (first[d - lo] + end[mine]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair[mine]), pa.array(side[mine]), pa.array([ids[i] for i in d.tolist()], pa.int64()), pa.array(begin[mine]), pa.array(cuts, pa.binary())],
                        names=["pair", "side", "id", "lo", "tokens"],
                    )

    cuts = rows.join(asked, "id").mapInArrow(lean(cut), "pair long, side int, id long, lo long, tokens binary")

    def verify(batches):
        last = None  # a pair whose second half is still to come
        for batch in batches:
            out = [], [], [], [], [], [], []
            for pair, side, i, lo, tokens in zip(*batch.to_pydict().values(), strict=True):
                if not side:
                    last = pair, i, lo, tokens
                    continue
                if last is None or last[0] != pair:
                    continue  # a row that repeats: its pair is done
                _, j, at, mine = last
                last = None
                for p, q, s, e, score in compare(np.frombuffer(mine, np.uint64), np.frombuffer(tokens, np.uint64), least, similarity):
                    found_ = (j, at + p, at + q + shingle - 1, i, lo + s, lo + e + shingle - 1, score)
                    for column, v in zip(out, found_, strict=True):
                        column.append(v)
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                names=["id", "start", "stop", "other", "other_start", "other_stop", "similarity"],
            )

    shape = "id long, start long, stop long, other long, other_start long, other_stop long, similarity double"
    near_found = cuts.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(lean(verify), shape)
    near_found = keep(near_found, "near_passages", drop_shuffles=True)
    words = rows.mapInArrow(count_words, "id long, words long").where(F.col("words") >= min_words)
    copies = equal.join(words, "id").select(
        "id", F.lit(0).cast("long").alias("start"), F.col("words").alias("stop"), F.col("lead").alias("other"),
        F.lit(0).cast("long").alias("other_start"), F.col("words").alias("other_stop"), F.lit(1.0).alias("similarity"),
    )
    out = keep(near_found.union(copies).distinct(), "passages", drop_shuffles=True)
    free(candidates, near, near_found, same)
    return out, names, plain


def passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    shingle: int = 5,
    similarity: float = 0.8,
    hashes: int = 4,
    agree: int = 1,
) -> DataFrame:
    """(id, start, stop, other, other_start, other_stop, similarity): words start to stop of a document that near-duplicate an earlier document's."""
    found, names, plain = _passages(docs, id_col, text_col, min_words, shingle, similarity, hashes, agree)
    if plain:
        return found
    a, b = (names.select(F.col("id").alias(x), F.col("own").alias(f"own_{x}")) for x in ("id", "other"))
    found = found.join(a, "id").join(b, "other").drop("id", "other").withColumnsRenamed({"own_id": "id", "own_other": "other"})
    return found.select("id", "start", "stop", "other", "other_start", "other_stop", "similarity").distinct()


def drop_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    shingle: int = 5,
    similarity: float = 0.8,
    hashes: int = 4,
    agree: int = 1,
) -> DataFrame:
    """The documents without the passages that near-duplicate an earlier document's; documents left without words go."""
    found, names, plain = _passages(docs, id_col, text_col, min_words, shingle, similarity, hashes, agree)
    found = found.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    own = F.col("id") if plain else F.col("own")
    found = found.join(names, "id").select(own.alias("_id"), F.col("text_key").alias("_key"), "_spans")
    found = keep(found, "spans", drop_shuffles=True)
    match = (col(id_col).cast("long") == F.col("_id")) & (F.xxhash64(col(text_col)) == F.col("_key"))
    at = docs.columns.index(text_col)
    rows = docs.join(found, match, "left").select(*[col(c) for c in docs.columns], "_spans")
    rows = rows.toDF(*[f"c{i}" for i in range(len(docs.columns))], "_spans")
    shape = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])

    def run(batches):
        for b in batches:
            texts, spans = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            out, stay = [], []
            for i, (text, ranges) in enumerate(zip(texts, spans, strict=True)):
                if ranges:
                    raw = text.encode()
                    w = Words([raw])
                    kept, done = [], 0
                    for lo, hi in sorted((r["start"], r["stop"]) for r in ranges):
                        lo, hi = int(w.start[lo]), int(w.end[hi - 1])
                        if hi > done:
                            kept.append(raw[done : max(lo, done)])
                            done = hi
                    kept.append(raw[done:])
                    raw = b"".join(kept)
                    if not raw.strip():
                        continue
                    text = raw.decode()
                out.append(text)
                stay.append(i)
            cols = [c.take(pa.array(stay, pa.int64())) for c in b.columns[:-1]]
            cols[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return rows.mapInArrow(lean(run), shape).toDF(*docs.columns)
