"""A Katz backoff language model: Good-Turing discounted bigrams over exactly normalised unigrams.

Tokens are words, A-Z lowered, and one end per text. Counts are taken over all
training texts. Unigrams: P1(w) = (c(w) + 1) / (N + V + 1), one place being kept
for words never seen, so P1 sums to one. All words have bigrams of their own.
Only if ``vocabulary`` is given, just so many of the most frequent words (and the
end) have them; the other words then share one class as context and as
successor, and a word's share of its class is P1(w) / P1(class).

For a bigram (v, w) seen n times after a context seen t times

    P(w | v) = d(n) n / t          d: Good-Turing discount for n <= ``k``, else 1

and a bigram not seen backs off to a(v) P1(w), where a(v) hands out what the
discounts left, divided by the P1 mass of all successors not seen. If the
discounts left nothing, t is one more; if every successor was seen, the seen ones
are scaled to one. So the successors of every context sum to one.

Words are told apart by 64-bit hashes, bigrams by those of both words. The
``common`` most frequent words are held by each task, and so are the counts of all
bigrams of the isqrt(``cached``) most frequent ones (fixed bounds, which change no
result). All other bigrams of a text are dealt out once, by context, those of a
frequent context by successor too, in ``shares`` jobs whose shuffle files do not lie
on disk together, and read in order: a bigram's rows follow each
other, so its count is known when its texts are told of it. A text needs only how
many of its bigrams were seen 1, 2, .. times, as discounts come later, and which were
never seen. A bigram with more than ``longest`` texts is not gathered: its texts meet
its count in a join. Contexts and words outside the held ones are joined by key. Only
counts of counts and the held tables reach the driver.

Cases: null text is empty and has the end alone; rows with a null id are scored
but teach nothing; equal rows count and are scored each; without training texts
every score is zero, as the one place for words never seen has all the mass; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import Words, col, free, keep, slices, utf8

# keys beside the word hashes: the end, the begin, the class of words outside a given vocabulary
END, BEGIN, OTHER = 0, 1, 2

# kinds of rows that counting gives: of a text its bigrams by count, of a context its successors by count, a bigram of a
# text that was never seen, a successor whose units no task holds, a text and the count of a bigram too long to gather
TEXT, CONTEXT, UNSEEN, COLD, LATE, COUNT = range(6)
#: parts into which a frequent context's successors are dealt
PARTS = 64


@dataclass
class Unigrams:
    """The commonest words' counts; N, V and the end's count; all words have bigrams, or those ``inside`` a vocabulary."""

    keys: np.ndarray  # sorted hashes of the common words
    counts: np.ndarray
    inside: np.ndarray | None
    tokens: int
    types: int
    ends: int

    @property
    def total(self) -> int:
        """Of all units of P1 mass; a word has one more than its count."""
        return self.tokens + self.types + 1

    @property
    def other(self) -> int:
        """Units of the class of words outside the vocabulary."""
        return self.total - int(self.counts[self.inside].sum()) - int(self.inside.sum()) - (self.ends + 1 if self.tokens else 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / self.total)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the common words, whether it is one)."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def classed(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Whether words found at ``at`` are in the class of the others."""
        if self.inside is None:
            return np.zeros(len(at), bool)
        return ~there | ~self.inside[at] if len(self.keys) else np.ones(len(at), bool)

    def chain(self, w: Words, words: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names in use, and of every token, ends included, the indexes of its context's and its own name and its text.

        ``words`` are the different hashes of ``w``, and ``which`` tells each word's place there.
        """
        n = len(w.counts)
        special = np.array([END, BEGIN], np.uint64)
        if self.inside is not None:
            names = np.concatenate([special, np.where(self.classed(*self.find(words)), np.uint64(OTHER), words)])
            names, name = np.unique(names, return_inverse=True)
        else:
            names = np.concatenate([special, words])
            name = np.arange(len(names))
        cur = np.full(len(w.hash) + n, name[0], np.int64)
        cur[np.arange(len(w.hash)) + w.doc] = name[which + 2]
        prev = np.empty_like(cur)
        prev[1:] = cur[:-1]
        prev[w.first[:-1] + np.arange(n)] = name[1]
        return names, prev, cur, np.repeat(np.arange(n), w.counts + 1)


def held_out(id_: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def unigrams(train: DataFrame) -> DataFrame:
    """(word, n) over the texts of ``train``; the end has the key END."""

    def run(batches):
        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in slices(texts, 4 << 20):
                keys, n = np.unique(Words(texts[lo:hi]).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(keys, np.uint64(END)).view(np.int64)), pa.array(np.append(n, hi - lo))], names=["word", "n"]
                )

    return train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, vocabulary: int | None, common: int) -> Unigrams:
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == END).first()
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(max(common, vocabulary or 0)).toArrow()
    keys = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    inside = None if vocabulary is None else (np.arange(len(keys)) < vocabulary)[order]
    return Unigrams(keys[order], top.column("n").to_numpy()[order], inside, tokens, types, ends["n"] if ends else 0)


def discounts(of: dict[int, int], k: int) -> list[float]:
    """Good-Turing discounts d(1..k) from the counts of counts 1..k+1; 1 where these do not give one within (0, 1]."""
    n1 = of.get(1, 0)
    tail = (k + 1) * of.get(k + 1, 0) / n1 if n1 else 1.0
    out = []
    for r in range(1, k + 1):
        star = (r + 1) * of.get(r + 1, 0) / (r * of[r]) if of.get(r) else 0.0
        d = (star - tail) / (1 - tail) if tail < 1 else 1.0
        out.append(d if 0 < d <= 1 else 1.0)
    return out


class Held:
    """Units of the words every task holds, and the counts of all bigrams of the most frequent ones."""

    def __init__(self, u: Unigrams, cached: int):
        inside = slice(None) if u.inside is None else u.inside
        keys, units = u.keys[inside], u.counts[inside] + 1
        side = isqrt(cached)
        top = keys[np.lexsort((keys, -units))]
        special = [END, BEGIN] if u.inside is None else [END, BEGIN, OTHER]
        self.hot = np.sort(np.concatenate([np.array(special, np.uint64), top])[:side])
        self.counts = np.zeros((len(self.hot), len(self.hot)), np.int64)
        self.keys = np.concatenate([np.array([END, BEGIN, OTHER], np.uint64), keys])
        self.units = np.concatenate([[u.ends + 1 if u.tokens else 1, 1, 1 if u.inside is None else max(u.other, 1)], units])
        order = np.argsort(self.keys)
        self.keys, self.units = self.keys[order], self.units[order]
        self.lt, self.la = np.zeros(len(self.keys)), np.zeros(len(self.keys))

    @staticmethod
    def _find(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(names):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        return at, names[at] == x

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the held words, whether it is one)."""
        return self._find(self.keys, words)

    def code(self, words: np.ndarray) -> np.ndarray:
        """A held word's index, which shuffles compress well, or the hash of another."""
        at, there = self.find(words)
        return np.where(there, at, words.view(np.int64))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        at, there = self.coded(codes)
        return np.where(there, self.keys[at].view(np.int64), codes)

    def coded(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``find``, of codes."""
        there = (codes >= 0) & (codes < len(self.keys))
        return np.where(there, codes, 0), there

    def frequent(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the most frequent words, whether it is one)."""
        return self._find(self.hot, words)


def frequent_bigrams(train: DataFrame, words, held) -> np.ndarray:
    """Counts of all bigrams of the most frequent words, a square table."""

    def run(batches):
        u, h = words.value, held.value
        counts = np.zeros_like(h.counts)
        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in slices(texts, 4 << 20):
                w = Words(texts[lo:hi])
                at, there = h.frequent(w.hash) if u.inside is None else h.frequent(np.where(u.classed(*u.find(w.hash)), np.uint64(OTHER), w.hash))
                (end, begin), ends = h.frequent(np.array([END, BEGIN], np.uint64))
                cur = np.full(len(at) + hi - lo, end if ends[0] else -1)
                cur[np.arange(len(at)) + w.doc] = np.where(there, at, -1)
                prev = np.append(-1, cur[:-1])
                prev[w.first[:-1] + np.arange(hi - lo)] = begin if ends[1] else -1
                both = (prev >= 0) & (cur >= 0)
                counts += np.bincount(prev[both] * len(counts) + cur[both], minlength=counts.size).reshape(counts.shape)
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(counts[i, j])], names=["i", "j", "n"])

    t = train.select("text").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros_like(held.value.counts)
    out[t.column("i").to_numpy(), t.column("j").to_numpy()] = t.column("n").to_numpy()
    return out


def bigrams(rows: DataFrame, words, held, share: int = 0, shares: int = 1) -> DataFrame:
    """(prev, part, cur, row, times) of the texts' bigrams that tasks do not hold, one of ``shares`` shares of them.

    Words are codes of ``held``; times are negative where a text teaches nothing.
    """

    def run(batches):
        u, h = words.value, held.value
        for b in batches:
            texts, ids = utf8(b.column(2)), b.column(0).to_numpy()
            train = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts, 2 << 20):
                w = Words(texts[lo:hi])
                names, prev, cur, doc = u.chain(w, *np.unique(w.hash, return_inverse=True))
                hot, of = h.frequent(names)[1], (names >> np.uint64(8)) % np.uint64(shares) == share
                i_hot = hot[prev]
                sent = np.where(i_hot, of[cur] & ~hot[cur], of[prev])
                # a slice has at most 2^21 names and texts or one text, so this does not overflow
                code, times = np.unique((prev[sent] * len(names) + cur[sent]) * (hi - lo) + doc[sent], return_counts=True)
                pair, doc = code // (hi - lo), code % (hi - lo) + lo
                prev, cur = pair // len(names), pair % len(names)
                part = np.where(hot[prev], (names % np.uint64(PARTS)).astype(np.int32)[cur], 0).astype(np.int32)
                codes = h.code(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(codes[prev]), pa.array(part), pa.array(codes[cur]),
                        pa.array(ids[doc]), pa.array(np.where(train[doc], times, -times)),
                    ],
                    names=["prev", "part", "cur", "row", "times"],
                )

    return rows.select("row", "train", "text").mapInArrow(run, "prev long, part int, cur long, row long, times long")


def sums(of: np.ndarray, n: np.ndarray, times: np.ndarray, large: np.ndarray, k: int) -> tuple[np.ndarray, dict]:
    """(the different values of ``of``, their sums of ``times`` for each n up to k + 1 and of ``large`` beyond k)."""
    keys, at = np.unique(of, return_inverse=True)
    out = {f"c{r}": np.bincount(at, times * (n == r), len(keys)).astype(np.int64) for r in range(1, k + 2)}
    return keys, out | {"x": np.bincount(at, np.where(n > k, large, 0.0), len(keys)).astype(float)}


def counted(pairs: DataFrame, held, k: int, longest: int) -> DataFrame:
    """What texts and contexts need of the counts of ``bigrams``, one row for each key and portion; ``kind`` tells which.

    Columns that a kind of row does not need are null, which costs less to write and read than a number.
    """
    numbers = [f"c{r}" for r in range(1, k + 2)]
    schema = "kind int, row long, prev long, cur long, times long, b long, x double, " + ", ".join(f"{c} long" for c in numbers)
    names = ["kind", "row", "prev", "cur", "times", "b", "x", *numbers]

    def batch(kind: int, size: int, **values):
        none = {"x": pa.nulls(size, pa.float64())}
        values = {c: held.value.decode(v) if c in ("prev", "cur") else v for c, v in values.items()}
        cols = none | {"kind": np.full(size, kind, np.int32)} | values
        return pa.RecordBatch.from_arrays([pa.array(cols[c]) if c in cols else pa.nulls(size, pa.int64()) for c in names], names=names)

    def successors(prev, cur, n):
        """Rows of contexts from bigrams, each once with its count."""
        at, there = held.value.coded(cur)
        keys, out = sums(prev, n, np.ones(len(n)), n, k)
        b = np.zeros(len(keys), np.int64)
        np.add.at(b, np.searchsorted(keys, prev), np.where(there, held.value.units[at], 0))
        yield batch(CONTEXT, len(keys), prev=keys, b=b, **out)
        yield batch(COLD, int((~there).sum()), prev=prev[~there], cur=cur[~there])

    def whole(prev, cur, row, times):
        """Rows of bigrams all of whose texts are here."""
        first = np.flatnonzero(np.append(True, (prev[1:] != prev[:-1]) | (cur[1:] != cur[:-1])))
        n = np.add.reduceat(np.maximum(times, 0), first)
        seen = n > 0
        yield from successors(prev[first][seen], cur[first][seen], n[seen])
        n, times = np.repeat(n, np.diff(np.append(first, len(prev)))), np.abs(times)
        seen = n > 0
        keys, out = sums(row[seen], n[seen], times[seen], times[seen] * np.log10(n[seen]), k)
        del out[f"c{k + 1}"]  # only contexts need it
        yield batch(TEXT, len(keys), row=keys, **out)
        new = ~seen
        yield batch(UNSEEN, int(new.sum()), row=row[new], prev=prev[new], cur=cur[new], times=times[new])

    def run(batches):
        waiting, size, long = [], 0, None  # long: the key being passed on as it comes, and its bigrams' counts so far

        def portion(last: bool):
            nonlocal waiting, size, long
            key, *cols = (np.concatenate(x) for x in zip(*waiting, strict=True))
            if long:
                head = int(np.searchsorted(key, long[0], "right"))
                yield from late(*(x[:head] for x in cols))
                key, cols = key[head:], [x[head:] for x in cols]
                if len(key) or last:
                    yield from close()
            cut = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1]))
            if cut:
                prev, cur = cols[0][:cut], cols[1][:cut]
                if ((key[1:cut] == key[: cut - 1]) & ((prev[1:] != prev[:-1]) | (cur[1:] != cur[:-1]))).any():
                    order = np.lexsort((cur, prev))
                    yield from whole(*(x[:cut][order] for x in cols))
                else:
                    yield from whole(*(x[:cut] for x in cols))
            rest = [x[cut:] for x in (key, *cols)]
            if len(rest[0]) > longest:
                long = (rest[0][0], {})
                yield from late(*rest[1:])
                rest = [x[:0] for x in rest]
            waiting, size = [rest], len(rest[0])

        def late(prev, cur, row, times):
            for p, c in {*zip(prev.tolist(), cur.tolist(), strict=True)}:
                n = np.maximum(times[(prev == p) & (cur == c)], 0).sum()
                long[1][p, c] = long[1].get((p, c), 0) + int(n)
            yield batch(LATE, len(row), row=row, prev=prev, cur=cur, times=np.abs(times))

        def close():
            nonlocal long
            prev, cur, n = (np.array(x, np.int64) for x in zip(*((*pair, n) for pair, n in long[1].items()), strict=True))
            long = None
            yield batch(COUNT, len(n), prev=prev, cur=cur, times=n)
            yield from successors(prev[n > 0], cur[n > 0], n[n > 0])

        for b in batches:
            waiting.append(tuple(b.column(c).to_numpy() for c in ("key", "prev", "cur", "row", "times")))
            size += b.num_rows
            if size >= 2 * min(longest, 1 << 18):
                yield from portion(False)
        if waiting:
            yield from portion(True)

    # half of the key from either word: one number sorts faster than two; bigrams that share a key are told apart above
    high = F.xxhash64("prev").bitwiseAND(F.lit(-1 << 32))
    key = high.bitwiseOR(F.shiftrightunsigned(F.xxhash64("cur"), 32))
    dealt = pairs.repartition("prev", "part").select(key.alias("key"), "prev", "cur", "row", "times").sortWithinPartitions("key")
    return dealt.mapInArrow(run, schema)


def contexts(rows: DataFrame, frequent: DataFrame, counts: DataFrame, total: int, k: int) -> tuple[DataFrame, list[float]]:
    """(prev, lt, la) of every context, the log10 of t and a(v), and the discounts; ``frequent`` has the held bigrams' rows."""
    numbers = [f"c{r}" for r in range(1, k + 2)]
    stats = rows.where(F.col("kind") == CONTEXT).select("prev", "b", "x", *numbers).union(frequent)
    of = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers]).first()
    d = discounts({r: of[f"c{r}"] for r in range(1, k + 2)}, k)
    t, s = F.col("x"), F.col("x")
    for r in range(1, k + 1):
        t, s = t + F.col(f"c{r}") * r, s + F.col(f"c{r}") * (r * d[r - 1])
    # successors that are not held meet their counts by key; sums of both parts make a context
    cold = rows.where(F.col("kind") == COLD).select("prev", "cur").join(counts, F.col("cur") == counts["word"])
    cold = cold.select("prev", F.lit(0.0).alias("t"), F.lit(0.0).alias("s"), (F.col("n") + 1).alias("b"))
    sums_ = stats.select("prev", t.alias("t"), s.alias("s"), "b").union(cold)
    sums_ = sums_.groupBy("prev").agg(F.sum("t").alias("t"), F.sum("s").alias("s"), F.sum("b").alias("b"))
    unseen = (F.lit(total) - F.col("b")) / F.lit(float(total))
    # every successor was seen; no discount left anything
    t = F.when(unseen <= 0, F.col("s")).when(F.col("t") - F.col("s") < 1e-9 * F.col("t"), F.col("t") + 1).otherwise(F.col("t"))
    sums_ = sums_.select("prev", t.alias("t"), "s", unseen.alias("unseen"))
    left = (F.col("t") - F.col("s")) / F.col("t")
    la = F.when((left > 0) & (F.col("unseen") > 0), F.log10(left / F.col("unseen"))).otherwise(0.0)
    return sums_.select("prev", F.log10("t").alias("lt"), la.alias("la")), d


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    vocabulary: int | None = None,
    common: int = 1 << 18,
    cached: int = 1 << 20,
    k: int = 5,
    longest: int = 1 << 20,
    shares: int = 2,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows of ``held_fold`` teach nothing."""
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), col(text_col).alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("id"), folds, held_fold))
    rows = keep(rows.withColumn("train", ~F.col("held_out") & F.col("id").isNotNull()), "katz_texts", compression="zstd")
    counts = keep(unigrams(rows.where("train")), "unigrams", drop_shuffles=True)
    u = commonest(counts, vocabulary, common)
    words, h = broadcast(u), Held(u, cached)
    held = broadcast(h)
    h.counts = frequent_bigrams(rows.where("train"), words, held)
    found = [keep(counted(bigrams(rows, words, held, i, shares), held, k, longest), "counted", drop_shuffles=True, apart=("kind", COUNT + 1)) for i in range(shares)]
    tables, found = found, reduce(DataFrame.union, found)

    # contexts; the held bigrams' share of them is summed up here
    i, j = np.nonzero(h.counts)
    n = h.counts[i, j]
    keys, part = sums(i, n, np.ones(len(n)), n, k)
    b = np.bincount(np.searchsorted(keys, i), h.units[h.find(h.hot[j])[0]], len(keys)).astype(np.int64)
    frequent = {"prev": h.hot[keys].view(np.int64), "b": b, "x": part.pop("x")} | part
    frequent = spark.createDataFrame(pa.table(frequent))
    table, d = contexts(found, frequent, counts, u.total, k)
    table = keep(table, "contexts", drop_shuffles=True)
    names = spark.createDataFrame(pa.table({"word": h.keys.view(np.int64), "units": h.units}))
    near = names.join(table, F.col("word") == F.col("prev"), "left").select("word", "units", F.coalesce("lt", F.lit(0.0)).alias("lt"), F.coalesce("la", F.lit(0.0)).alias("la"))
    near = keep(near, "common_words", drop_shuffles=True)
    got = near.toArrow()
    at = h.find(got.column("word").to_numpy().view(np.uint64))[0]
    h.lt[at], h.la[at] = got.column("lt").to_numpy(), got.column("la").to_numpy()
    model = broadcast(h)

    scored = keep(texts_scored(rows, words, model, d), "scored")
    # bigrams of texts by their counts; those too long to gather meet their count here
    late = found.where(F.col("kind") == LATE).select("row", "prev", "cur", "times")
    late = late.join(found.where(F.col("kind") == COUNT).select("prev", "cur", F.col("times").alias("n")), ["prev", "cur"])
    value = F.element_at(F.array(*[F.lit(float(np.log10(x * r))) for r, x in enumerate(d, 1)]), F.least(F.col("n"), F.lit(k)).cast("int"))
    none = F.lit(0).cast("long")
    seen = late.where("n > 0").select("row", F.lit(0.0).alias("base"), (F.col("times") * F.when(F.col("n") > k, F.log10("n")).otherwise(value)).alias("pairs"), none.alias("known"))
    total = F.col("x")
    for r, x in enumerate(d, 1):
        total = total + F.col(f"c{r}") * float(np.log10(x * r))
    direct = found.where(F.col("kind") == TEXT).select("row", F.lit(0.0).alias("base"), total.alias("pairs"), none.alias("known")).union(seen)
    # bigrams never seen: the words that tasks hold, then the others by key
    new = found.where(F.col("kind") == UNSEEN).select("row", "prev", "cur", "times").union(late.where("n = 0").select("row", "prev", "cur", "times"))
    left = near.select(F.col("word").alias("prev"), (F.col("lt") + F.col("la")).alias("of_prev"))
    right = near.select(F.col("word").alias("cur"), F.log10(F.col("units") / float(u.total)).alias("of_cur"))
    new = new.join(F.broadcast(left), "prev", "left").join(F.broadcast(right), "cur", "left")
    held_part = new.select("row", F.lit(0.0).alias("base"), (F.col("times") * (F.coalesce("of_prev", F.lit(0.0)) + F.coalesce("of_cur", F.lit(0.0)))).alias("pairs"), none.alias("known"))
    after = new.where("of_prev is null").join(table, "prev").select("row", F.lit(0.0).alias("base"), (F.col("times") * (F.col("lt") + F.col("la"))).alias("pairs"), none.alias("known"))
    # words that tasks do not hold: as tokens, as contexts (each is followed by a token), and after contexts that never had them
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x"))
    rare = rare.select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"), none.alias("backed"))
    rare = rare.union(new.where("of_cur is null").select("row", "cur", none, "times"))
    rare = rare.groupBy("row", "word").agg(F.sum("times").alias("times"), F.sum("backed").alias("backed"))
    known = counts.join(table, counts["word"] == table["prev"], "left").select("word", "n", "lt")
    rare = rare.join(known, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chance = F.log10((F.col("n") + 1.0) / float(u.total))
    # words of a class score their share of it, all others score by bigrams
    share = F.col("backed") * chance - F.col("times") * F.coalesce("lt", F.lit(0.0)) if u.inside is None else F.col("times") * chance
    rare = rare.select("row", (F.col("times") * chance).alias("base"), share.alias("pairs"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"))
    more = direct.union(held_part).union(after).union(rare)
    more = more.groupBy("row").agg(F.sum("base").alias("base"), F.sum("pairs").alias("pairs"), F.sum("known").alias("known"))
    out = scored.select("row", "id", "held_out", "n_tokens", "n_known", "base_score", "score").join(more, "row", "left")
    out = out.select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(u.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("pairs", F.lit(0.0))).alias("score"),
    )
    free(rows)
    out = keep(out, "katz_scores", drop_shuffles=True)
    free(counts, *tables, table, near, scored)
    return out


def texts_scored(rows: DataFrame, words, model, d: list[float]) -> DataFrame:
    """What a task can tell of its texts: base score and score of the words and bigrams held, and the other words.

    All bigrams count as seen here, so each takes lt of its context; those never
    seen give it back.
    """
    kind = rows.schema["id"].dataType.simpleString()
    k = len(d)

    def lists(doc: np.ndarray, n_docs: int, *values: np.ndarray) -> list[pa.Array]:
        offsets = pa.array(np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]

    def run(batches):
        u, h = words.value, model.value
        of = np.log10(np.array([1.0, *[x * r for r, x in enumerate(d, 1)]]))
        # the scores of the bigrams held, NaN where never seen; of the words held after a context without them, and as tokens
        pairs = np.where(h.counts > k, np.log10(np.maximum(h.counts, 1)), np.where(h.counts > 0, of[np.minimum(h.counts, k)], np.nan))
        gone, units, common_ = h.lt + h.la, np.log10(h.units / u.total), u.base(u.counts.astype(float))
        other = 0.0 if u.inside is None else float(np.log10(max(u.other, 1) / u.total))
        for batch in batches:
            texts = utf8(batch.column(3))
            for lo, hi in slices(texts, 2 << 20):
                n = hi - lo
                w = Words(texts[lo:hi])
                words_, which = np.unique(w.hash, return_inverse=True)
                at, there = u.find(words_)
                names, prev, cur, doc = u.chain(w, words_, which)
                (p, p_held), (i, hot) = h.find(names), h.frequent(names)
                value = np.where(p_held, -h.lt[p], 0.0)[prev]
                both = np.flatnonzero(hot[prev] & hot[cur])
                prev, cur = prev[both], cur[both]
                seen = pairs[i[prev], i[cur]]
                value[both] += np.where(np.isnan(seen), gone[p][prev] + units[p][cur], seen)
                score = np.bincount(doc, value, n)
                # unigrams: the end, common words, and the hashes of the others
                base = np.full(n, float(u.base(np.array(u.ends))))
                of_word = np.where(there, common_[at], 0.0) if len(u.keys) else np.zeros(len(words_))
                base += np.bincount(w.doc, of_word[which], n)
                if u.inside is not None:
                    # of words outside the vocabulary the share of their class
                    classed = u.classed(at, there)[which]
                    score -= np.bincount(w.doc[classed], minlength=n) * other
                    score += np.bincount(w.doc[classed], of_word[which[classed]], n)
                known = there[which]
                code, times = np.unique(w.doc[~known] * len(words_) + which[~known], return_counts=True)
                rare_doc, rare = code // max(len(words_), 1), words_[code % max(len(words_), 1)]
                seen = np.bincount(w.doc[known], minlength=n) + int(u.ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(lo, n) for c in range(3)], pa.array(w.counts + 1), pa.array(seen), pa.array(base), pa.array(score),
                        *lists(rare_doc, n, rare.view(np.int64), times),
                    ],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "rare_n"],
                )

    return rows.select("row", "id", "held_out", "text").mapInArrow(
        run,
        f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "rare array<long>, rare_n array<long>",
    )
