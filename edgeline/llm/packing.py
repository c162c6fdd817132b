"""Best-fit packing of tokenised documents into fixed-length sequences.

A document is its token ids and an end id. Only documents above the capacity
are cut, into full pieces and a rest. Pieces of one length are alike, so the
instance is a histogram: at most ``capacity`` lengths with counts, whatever the
number of documents. It is solved as a whole:

1. Martello-Toth dominance reduction. From the longest length to the shortest, a
   piece goes: alone, if nothing fits beside it; with the longest partner that
   fits, if that fills the sequence, or no two pieces fit, or no three fit and
   the partner is at least as long as any two that fit instead; with the best
   two, if no three fit, the longer one is as long as the partner, and the two
   fill the sequence or no length lies between theirs. Such a set dominates
   every other sequence holding the piece, so it is fixed, as many times as the
   counts allow, and the instance shrinks. A piece with no such set is passed
   over, and passes repeat until one fixes nothing.
2. Best fit, longest first, for the remainder.

The solution is a list of sequence patterns with multiplicities. Pieces are
numbered within their length, and a number tells pattern, repeat and place, so
documents meet their places in one join on bounded tables.

Cases: null text is empty, and an empty document is its end id alone; repeated
rows are packed each; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import Words, col, keep, lean, mix, rank_in_groups, slices

Pattern = list[tuple[int, int]]  # (length, pieces of it), longest first

#: So many encoded words, and so many before these, stay in a worker.
WORDS = 150_000
_ENCODERS: dict[str, tuple] = {}
_APART = np.zeros(256, bool)
_APART[[10, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(punctuation.encode())] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Recent:
    """A dictionary of what was met lately: a full one steps back and still answers until the next is full."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def find(self, keys: list) -> tuple[list, list[int]]:
        """(values or None, places of the missing)."""
        new, old = self.new, self.old
        values = [new.get(k) for k in keys]
        missing = []
        for i in [i for i, v in enumerate(values) if v is None]:
            v = old.get(keys[i])
            if v is None:
                missing.append(i)
            else:
                values[i] = new[keys[i]] = v
        return values, missing

    def add(self, keys: list, values: list) -> None:
        if len(self.new) + len(keys) > self.most:
            self.new, self.old = {}, self.new
        self.new.update(zip(keys, values, strict=True))


class Plain:
    """Encodes words of plain letters by the tokenizer's model alone, where that gives the same as all its steps."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.model = tokenizer, tokenizer.model
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
        self.spelling = str.maketrans({c: spell.pre_tokenize_str(c)[0][0] for c in letters})
        trial = ["a", "the", "straße", "être", "ÉLÈVE", "qwxzjkv", "niño", "internationalization", "ÿ", *letters]
        self.same = self.alone(trial) == _encode_each(tokenizer, trial)

    def alone(self, words: list[str]) -> list[bytes]:
        split, spelling = self.model.tokenize, self.spelling
        return [np.array([t.id for t in split(w.lower().translate(spelling))], np.uint32).tobytes() for w in words]

    def encode(self, words: list[str]) -> list[bytes]:
        return self.alone(words) if self.same else _encode_each(self.tokenizer, words)


def _encode_each(tokenizer, parts: list[str]) -> list[bytes]:
    return [np.array(e.ids, np.uint32).tobytes() for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids of texts as 32-bit numbers.

    The tokenizers this serves drop white space and end every token there, keep
    letters and punctuation apart and lower all letters. So a text is cut at
    blanks and line breaks, and a chunk of plain letters (ASCII, or U+00C0 to
    U+00FF, which stay one letter when lowered and normalised) with ASCII
    punctuation behind it is the word and the punctuation. These are found by
    array arithmetic and told apart by a 64-bit hash and the length; each is
    encoded once while it stays known. Every other chunk is encoded as it is.
    """
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        _ENCODERS[path] = (made, Plain(made), Recent(WORDS), Recent(WORDS // 4))
    tokenizer, plain_words, words, chunks = _ENCODERS[path]
    w = Words([t.encode() for t in texts], _APART, spans=True)
    raw, n = w.raw, len(w.start)
    if not n:
        return [b""] * len(texts)
    joined = raw.tobytes()
    # the word of a chunk ends with its last byte that is no punctuation
    solid = np.maximum.accumulate(np.where(_MARK[raw], -1, np.arange(len(raw))))[w.end - 1]
    middle = np.maximum(solid + 1, w.start)
    pair = np.zeros(len(raw), bool)  # both bytes of a letter of U+00C0 to U+00FF
    pair[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    pair[:-1] |= pair[1:]
    strange = np.concatenate([[0], np.cumsum(~(_LETTER[raw] | pair))])
    plain = (strange[middle] == strange[w.start]) & (w.end - w.start <= 64)
    # words, then punctuation, of the plain chunks
    first = np.stack([w.start, middle], 1)[plain].ravel()
    last = np.stack([middle, w.end], 1)[plain].ravel()
    there = np.flatnonzero(last > first)
    keys = mix(w.span_hash(first[there], last[there]) + (last - first)[there].astype(np.uint64))
    keys, example, which = np.unique(keys, return_index=True, return_inverse=True)
    names = keys.tolist()
    values, missing = words.find(names)
    if missing:
        at = there[example[missing]]
        parts = [joined[a:b].lower().decode() for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)]
        letters = [i for i, p in enumerate(parts) if p[0] not in punctuation]
        marks = [i for i, p in enumerate(parts) if p[0] in punctuation]
        found = [b""] * len(parts)
        for where, ids in ((letters, plain_words.encode([parts[i] for i in letters])), (marks, _encode_each(tokenizer, [parts[i] for i in marks]))):
            for i, x in zip(where, ids, strict=True):
                found[i] = x
        words.add([names[i] for i in missing], found)
        for i, x in zip(missing, found, strict=True):
            values[i] = x
    # other chunks, as they are
    odd = np.flatnonzero(~plain)
    odd_bytes = [joined[a:b] for a, b in zip(w.start[odd].tolist(), w.end[odd].tolist(), strict=True)]
    odd_names = list(dict.fromkeys(odd_bytes))
    odd_values, missing = chunks.find(odd_names)
    if missing:
        found = _encode_each(tokenizer, [odd_names[i].decode() for i in missing])
        short = [j for j, i in enumerate(missing) if len(odd_names[i]) <= 64]
        chunks.add([odd_names[missing[j]] for j in short], [found[j] for j in short])
        for i, x in zip(missing, found, strict=True):
            odd_values[i] = x
    place = dict(zip(odd_names, range(len(values), len(values) + len(odd_names)), strict=True))
    values += odd_values
    # two parts a chunk, in order; part 0 of nothing has no ids
    part = np.full((n, 2), len(values), np.int64)
    mine = np.full(len(first), len(values), np.int64)
    mine[there] = which
    part[plain] = mine.reshape(-1, 2)
    part[odd, 0] = np.fromiter((place[x] for x in odd_bytes), np.int64, len(odd_bytes))
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    size = np.append(size, 0)
    begin = np.cumsum(size) - size
    ids = np.frombuffer(b"".join(values), np.uint32)
    part = part.ravel()
    size = size[part]
    stop = np.cumsum(size)
    out = ids[np.arange(stop[-1]) + np.repeat(begin[part] - stop + size, size)].tobytes()
    edges = np.append(0, stop)[2 * w.first] * 4
    return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document; ``tokenizer`` is a tokenizers file."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    fields = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], np.uint32).tobytes()
    wide = 4 * capacity

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in slices(texts, 1 << 18):
                owner, no, start, parts = [], [], [], []
                for i, data in enumerate(encode(texts[lo:hi], tokenizer), lo):
                    data += end
                    for k, at in enumerate(range(0, len(data), wide)):
                        owner.append(i)
                        no.append(k)
                        start.append(at // 4)
                        parts.append(data[at : at + wide])
                length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
                out = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(map(zlib.crc32, parts), pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    edges = np.append(0, np.cumsum(length)).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(parts), np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(lean(run), fields + (", ids array<int>" if with_ids else ""))


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Martello-Toth reduction: sequences fixed for good with their multiplicities, and the counts left over."""
    counts = {s: c for s, c in counts.items() if c}
    sizes = sorted(counts)
    fixed: list[tuple[Pattern, int]] = []

    def fits(room: int, used: dict[int, int]) -> int | None:
        """The longest length up to ``room`` with a piece beside those in ``used``."""
        i = bisect_left(sizes, room + 1) - 1
        while i >= 0 and counts[sizes[i]] <= used.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else None

    def fix(members: list[int]) -> None:
        need = {s: members.count(s) for s in members}
        times = min(counts[s] // k for s, k in need.items())
        fixed.append((sorted(need.items(), reverse=True), times))
        for s, k in need.items():
            counts[s] -= times * k
            if not counts[s]:
                del counts[s]
                sizes.remove(s)

    def best_pair(room: int, top: int) -> tuple[int, int] | None:
        """The two pieces beside ``top`` that fill ``room`` best."""
        best, i, j = None, 0, bisect_left(sizes, room) - 1
        while j >= i >= 0:
            a, b = sizes[j], sizes[i]
            need = {top: 1}
            for s in (a, b):
                need[s] = need.get(s, 0) + 1
            if a + b > room:
                j -= 1
            elif counts[a] < need[a] or counts[b] < need[b]:
                # a lone piece can't be taken twice: try it with its neighbours on either side
                if i == j:
                    break
                if counts[b] < need[b]:
                    i += 1
                else:
                    j -= 1
            else:
                if best is None or a + b > sum(best) or (a + b == sum(best) and a > best[0]):
                    best = (a, b)
                i += 1
        return best

    def dominating(top: int, room: int) -> list[int] | None:
        partner = fits(room, {top: 1})
        if partner is None:
            return [top]
        few = _smallest(sizes, counts, top)
        if partner == room or few[0] + few[1] > room:
            return [top, partner]
        if sum(few) <= room:
            return None
        pair = best_pair(room, top)
        if pair is None or partner >= sum(pair):
            return [top, partner]
        a, b = pair
        between = bisect_left(sizes, a) - bisect_left(sizes, b) <= 1
        return [top, a, b] if partner == a and (between or a + b == room) else None

    again = True
    while again and sizes:
        again = False
        at = len(sizes) - 1
        while at >= 0:
            top = sizes[at]
            members = dominating(top, capacity - top)
            if members:
                fix(members)
                again = True
                # the same length again while it has pieces, else the next shorter one
                at = bisect_left(sizes, top + 1) - 1
            else:
                at -= 1
    return fixed, counts


def _smallest(sizes: list[int], counts: dict[int, int], top: int) -> list[int]:
    """The three smallest pieces beside one of ``top``; missing ones count as endless."""
    out: list[int] = []
    for s in sizes[:4]:
        out += [s] * min(3, counts[s] - (s == top))
        if len(out) >= 3:
            break
    return [*out, *[1 << 40] * 3][:3]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first: each piece goes where the least room is left. Equal sequences are kept as one with a count."""
    closed: list[tuple[Pattern, int]] = []
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}  # room -> [pattern, sequences]

    def put(pattern: Pattern, times: int, room: int) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append([pattern, times])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                pattern, times, room = [], left, capacity
            else:
                room = rooms[i]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            each = room // size
            full = min(times, left // each)
            if full:
                put([*pattern, (size, each)], full, room - full_room(each, size))
            left -= full * each
            times -= full
            if pattern and times and left:
                put([*pattern, (size, left)], 1, room - left * size)
                left, times = 0, times - 1
            elif not pattern and left and left < each:
                put([(size, left)], 1, room - left * size)
                left = 0
            if pattern and times:
                put(pattern, times, room)
    for group in open_.values():
        closed += [(p, t) for p, t in group]
    return closed


def full_room(each: int, size: int) -> int:
    return each * size


def solve(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pack(rows: DataFrame, order: list[str], capacity: int = 2048, solver: Callable = solve) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; ``order`` tells rows apart."""
    spark = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not s or s > capacity for s in counts):
        raise ValueError("lengths from 1 to the capacity are needed")
    begun: dict[int, int] = dict.fromkeys(counts, 0)
    places, first = [], 0
    for pattern, times in solver(counts, capacity):
        offset = 0
        for size, each in pattern:
            lo = begun[size]
            begun[size] = hi = lo + times * each
            places.append((size, lo, hi, each, first, offset))
            offset += size * each
        first += times
    if begun != counts:
        raise AssertionError("the patterns do not hold every piece once")
    # a length has a place for each pattern that holds it: bounded by the lengths, not by the rows
    table = spark.createDataFrame(places, "size int, lo long, hi long, each long, first long, at long")
    # numbers are cut into cells, about 2^12 in all, so that few places share one
    wide = max(1, sum(counts.values()) >> 12)
    cells = table.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))))
    starts = cells.groupBy("size", "cell").agg(F.collect_list(F.struct("lo", "hi", "each", "first", "at")).alias("places"))
    ranked = rank_in_groups(rows, ["length"], order, "_rank").withColumn("_cell", F.floor(F.col("_rank") / wide))
    out = ranked.join(F.broadcast(starts), (F.col("length") == F.col("size")) & (F.col("_cell") == F.col("cell")))
    out = out.withColumn("_p", F.expr("filter(places, p -> p.lo <= _rank and _rank < p.hi)[0]"))
    nth = F.col("_rank") - F.col("_p.lo")
    return (
        out.withColumn("sequence_id", (F.col("_p.first") + F.floor(nth / F.col("_p.each"))).cast("long"))
        .withColumn("offset", (F.col("_p.at") + F.pmod(nth, F.col("_p.each")) * F.col("length")).cast("long"))
        .drop("_rank", "_p", "places", "size", "cell", "_cell")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """Every piece of every document with its token ids, its sequence and its place there."""
    rows = keep(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack(rows, ["id", "piece", "length", "ids_crc32"], capacity)
