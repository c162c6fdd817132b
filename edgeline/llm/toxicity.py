"""Toxicity scores by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is cut into words (runs of letters, digits, apostrophes and bytes beyond
ASCII, A-Z lowered) and scored in windows of ``WIDTH`` words, each starting half a
window after the one before, so that windows overlap and every word is in one.
The input of a word is its word vector beside the sum of the vectors of its
character strings of 4 and 5 bytes, begin and end marked. Two gated recurrent
layers run over a window, one in each direction; attention weighs their states
and the weighted mean gives the window's logit. A text scores as its highest
window does.

The labels belong to texts and the network reads windows, so training goes in
rounds: each takes the window of every text that scores highest, then fits them
by Adam. Windows of texts of class 0 stay in the pool, so what once looked toxic
and was not is learnt. The first round ranks windows by the words' log-odds,
which also start one coordinate of the vectors.

The fit uses at most ``sample`` labelled texts of each class of at most ``longest``
bytes, those with the smallest hashes of their ids outside the held-out fold
(documented bounds, 32 MB of text at most); one task trains on them in numpy and
returns the weights. Only words and strings whose share differs between the
classes by several standard deviations get vectors. Scoring reads every text
whole.

Cases: null text is empty; an empty text is a window of padding, which training
shows as class 0; equal rows teach once, rows with several labels with each, null
labels not at all; without rows of both classes every score is the share of class 1 (0.5
without any); equal texts score alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import Words, col, keep, slices, utf8
from edgeline.llm.quality import bucket

WIDTH, STEP = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
GRAMS = (4, 5)
_APART = np.ones(256, bool)
for _range in (range(65, 91), range(97, 123), range(48, 58), range(128, 256), [39]):
    _APART[list(_range)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FILTER = 1 << 20


def _place(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class Lexicon:
    """Sorted keys, found by binary search behind a bit table that turns most strangers away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.gate = np.zeros(_FILTER, bool)
        self.gate[_place(self.keys)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``codes`` that are known, their places among the keys)."""
        at = np.flatnonzero(self.gate[_place(codes)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.keys, codes[at]), len(self.keys) - 1)
        known = self.keys[place] == codes[at]
        return at[known], place[known]


class Inputs:
    """The distinct words of some texts, their character strings, and the windows over them."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, _APART)
        self.n = len(texts)
        self.words, first, self.which = np.unique(w.hash, return_index=True, return_inverse=True)
        self.first = w.first
        start, length = w.start[first], (w.end - w.start)[first]
        size = length + 2
        begin = np.concatenate([[0], np.cumsum(size)])
        self.owner = np.repeat(np.arange(len(size)), size)
        inner = np.arange(begin[-1]) - begin[self.owner]
        self.letters = np.full(begin[-1], 1, np.uint8)
        solid = (inner > 0) & (inner <= length[self.owner])
        self.letters[solid] = _LOWER[w.raw[start[self.owner[solid]] + inner[solid] - 1]]
        self.left = size[self.owner] - inner  # bytes from here to the end of the word's string

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distinct words) of the character strings of n bytes."""
        at = np.flatnonzero(self.left >= n)
        code = np.full(len(at), n, np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | self.letters[at + j]
        return code, self.owner[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, text) of every window; an empty text has one of padding."""
        counts = np.diff(self.first)
        each = np.maximum(1, -(-(counts - WIDTH) // STEP) + 1)
        text = np.repeat(np.arange(self.n), each)
        nth = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(each)[:-1]]), each)
        return self.first[text] + nth * STEP, text

    def fill(self, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WIDTH): distinct word at each place, and 1 where there is one, else 0."""
        at = start[:, None] + np.arange(WIDTH)
        there = at < self.first[text + 1][:, None]
        if not len(self.which):
            return np.zeros(at.shape, np.int64), np.zeros(at.shape, np.float32)
        return np.where(there, self.which[np.where(there, at, 0)], 0), there.astype(np.float32)


def _gates(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """Update gate, reset gate, candidate, and the candidate's recurrent part."""
    k = h.shape[1]
    a = h @ u
    zr = np.tanh((x[:, : 2 * k] + a[:, : 2 * k]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
    z, r = zr[:, :k], zr[:, k:]
    return z, r, np.tanh(x[:, 2 * k :] + r * a[:, 2 * k :]), a[:, 2 * k :]


@dataclass
class Network:
    """Vocabulary and weights. ``p`` holds the arrays that training changes."""

    words: Lexicon
    grams: Lexicon
    p: dict[str, np.ndarray]

    def known(self, x: Inputs) -> tuple[np.ndarray, ...]:
        """Word row, and (character string row, owner) pairs by owner, of the distinct words; row 0 is for strangers."""
        row = np.zeros(len(x.words), np.int64)
        at, place = self.words.find(x.words)
        row[at] = place + 1
        rows, owners = [], []
        for n in GRAMS:
            code, owner = x.grams(n)
            at, place = self.grams.find(code)
            rows.append(place + 1)
            owners.append(owner[at])
        gram, owner = np.concatenate(rows), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return row, gram[order], owner[order]

    def inputs(self, known: tuple[np.ndarray, ...]) -> np.ndarray:
        row, gram, owner = known
        chars = np.zeros((len(row), CHAR_DIM), np.float32)
        if len(gram):
            edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            chars[owner[edge]] = np.add.reduceat(self.p["chars"][gram], edge, axis=0)
        return np.concatenate([self.p["words"][row], chars], 1)

    def run(self, project: list[np.ndarray], at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """States of both directions (windows, WIDTH, 2 HIDDEN), attention, pooled states and logits."""
        b = len(at)
        states = np.empty((WIDTH, b, 2 * HIDDEN), np.float32)
        for d, times in enumerate((range(WIDTH), range(WIDTH - 1, -1, -1))):
            h = np.zeros((b, HIDDEN), np.float32)
            for t in times:
                z, _, n, _ = _gates(project[d][at[:, t]], h, self.p[f"u{d}"])
                h = h + z * mask[:, t : t + 1] * (n - h)
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        s = states @ self.p["attend"] + (mask.T - 1) * 1e4
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        a *= mask.T
        pooled = np.einsum("tb,tbk->bk", a, states)
        return states, a, pooled, pooled @ self.p["out"] + self.p["bias"]

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in range(2)]

    def window_logits(self, x: Inputs, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logit, first word, text) of every window."""
        project = self.project(self.inputs(self.known(x))) if len(x.words) else [np.zeros((1, 3 * HIDDEN), np.float32)] * 2
        start, text = x.windows()
        out = np.empty(len(start), np.float32)
        for lo in range(0, len(start), chunk):
            part = slice(lo, lo + chunk)
            out[part] = self.run(project, *x.fill(start[part], text[part]))[3]
        return out, start, text

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in slices(texts):
            x = Inputs(texts[lo:hi])
            logit, _, text = self.window_logits(x)
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[lo:hi] = np.maximum.reduceat(logit, first)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -700, 700)))

    def gradients(self, known: tuple[np.ndarray, ...], at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of some windows of class ``y``."""
        row, gram, owner = known  # sorted by owner
        words, where = np.unique(at, return_inverse=True)
        where = where.reshape(at.shape)
        first, last = np.searchsorted(owner, words), np.searchsorted(owner, words, "right")
        times = last - first
        pick = np.arange(times.sum()) + np.repeat(first - np.cumsum(times) + times, times)
        gram, owner = gram[pick], np.repeat(np.arange(len(words)), times)
        x = self.inputs((row[words], gram, owner))
        project = self.project(x)
        states, a, pooled, logit = self.run(project, where, mask)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_logit = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g["out"] = pooled.T @ d_logit
        g["bias"] = d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("tbk,bk->tb", states, d_pooled)
        d_s = a * (d_a - (a * d_a).sum(0))
        g["attend"] = np.einsum("tb,tbk->k", d_s, states)
        d_states += d_s[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        order = np.argsort(where.T.ravel(), kind="stable")
        edge = np.searchsorted(where.T.ravel()[order], np.arange(len(words)))
        k = HIDDEN
        for d, times in enumerate((range(WIDTH - 1, -1, -1), range(WIDTH))):
            u, mine = self.p[f"u{d}"], slice(d * k, (d + 1) * k)
            d_gates = np.empty((WIDTH, len(at), 3 * k), np.float32)
            carry = np.zeros((len(at), k), np.float32)
            for t in times:
                before = t - 1 if d == 0 else t + 1
                h = states[before, :, mine] if 0 <= before < WIDTH else np.zeros((len(at), k), np.float32)
                z, r, n, part = _gates(project[d][where[:, t]], h, u)
                m = mask[:, t : t + 1]
                dh = d_states[t, :, mine] + carry
                d_n = dh * z * m * (1 - n * n)
                d_z = dh * m * (n - h) * z * (1 - z)
                d_r = d_n * part * r * (1 - r)
                d_gates[t] = np.concatenate([d_z, d_r, d_n], 1)
                d_rec = np.concatenate([d_z, d_r, d_n * r], 1)
                g[f"u{d}"] += h.T @ d_rec
                carry = dh * (1 - z * m) + d_rec @ u.T
            d_project = np.add.reduceat(d_gates.reshape(-1, 3 * k)[order], edge, axis=0)
            g[f"w{d}"] = x.T @ d_project
            g[f"b{d}"] = d_project.sum(0)
            d_x += d_project @ self.p[f"w{d}"].T
        np.add.at(g["words"], row[words], d_x[:, :WORD_DIM])
        np.add.at(g["chars"], gram, d_x[owner, WORD_DIM:])
        g["words"][0] = g["chars"][0] = 0  # strangers stay neutral
        return g


def _telling(keys: np.ndarray, text: np.ndarray, y: np.ndarray, most: int, surely: float = 3.8) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` keys whose shares of texts differ most between the classes, by ``surely`` deviations at least, and their log-odds."""
    names, which = np.unique(keys, return_inverse=True)
    pair = np.unique(which * len(y) + text)
    which, text = pair // len(y), pair % len(y)
    n1, n0 = y.sum(), len(y) - y.sum()
    in1 = np.bincount(which, y[text], len(names))
    in0 = np.bincount(which, 1 - y[text], len(names))
    p1, p0 = in1 / n1, in0 / n0
    spread = np.sqrt((in1 + in0 + 1) / len(y) * (1 / n1 + 1 / n0))
    z = (p1 - p0) / spread
    odds = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    top = np.argsort(-np.abs(z) - 1e-9 * p1, kind="stable")[:most]
    top = top[np.abs(z[top]) >= surely]
    top = top[np.argsort(names[top])]
    return names[top], odds[top]


def train(
    texts: list[bytes], labels: np.ndarray, words: int = 4096, strings: int = 8192, rounds: int = 3, epochs: int = 6,
    batch: int = 256, rate: float = 0.015, decay: float = 1e-4, seed: int = 13,
) -> Network:
    """A network fitted to texts of class 0 and 1; the same texts in the same order give the same one."""
    rng = np.random.default_rng(seed)
    x = Inputs([*texts, b""])
    y = np.append(labels, 0).astype(np.float32)
    owner = np.repeat(np.arange(x.n), np.diff(x.first))
    word_keys, word_odds = _telling(x.words[x.which], owner, y, words)
    codes, odds = [], []
    holders = np.unique(x.which * x.n + owner)
    first = np.searchsorted(holders, np.arange(len(x.words) + 1) * x.n)
    for n in GRAMS:
        code, word = x.grams(n)
        times = np.diff(first)[word]
        at = np.repeat(first[word], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        k, o = _telling(np.repeat(code, times), holders[at] % x.n, y, strings // len(GRAMS))
        codes.append(k)
        odds.append(o)
    gram_keys, gram_odds = np.concatenate(codes), np.concatenate(odds)
    order = np.argsort(gram_keys)
    gram_keys, gram_odds = gram_keys[order], gram_odds[order]

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    dim = WORD_DIM + CHAR_DIM
    p = {"words": normal(len(word_keys) + 1, WORD_DIM, scale=0.05), "chars": normal(len(gram_keys) + 1, CHAR_DIM, scale=0.05)}
    for name, start, share in (("words", word_odds, 0.25), ("chars", gram_odds, 0.1)):
        p[name][0] = 0
        p[name][1:, 0] = np.clip(start, -6, 6) * share
    for d in range(2):
        p[f"w{d}"] = normal(dim, 3 * HIDDEN, scale=dim**-0.5)
        p[f"u{d}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        p[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
    p |= {"attend": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
    net = Network(Lexicon(word_keys), Lexicon(gram_keys), p)
    known = net.known(x)
    start, text = x.windows()
    seed_vectors = net.inputs(known)
    heat = seed_vectors[:, 0] + seed_vectors[:, WORD_DIM]
    logit = np.concatenate([(heat[at] * mask).max(1) for lo in range(0, len(start), 8192) for at, mask in (x.fill(start[lo : lo + 8192], text[lo : lo + 8192]),)])
    pool = rng.permutation(np.flatnonzero(y[text] == 0))[: len(y)]  # some windows of class 0 as they come
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        if turn:
            logit = net.window_logits(x)[0]
        ranked = np.lexsort((-logit, text))
        top = ranked[np.concatenate([[True], text[ranked][1:] != text[ranked][:-1]])]
        second = np.setdiff1d(ranked[np.flatnonzero(np.concatenate([[False], np.isin(ranked[:-1], top)]))], top)
        pool = np.union1d(pool, np.concatenate([top[y[text[top]] == 0], second[y[text[second]] == 0]]))
        ones = top[y[text[top]] == 1]
        weigh = max(1, round(len(pool) / max(len(ones), 1)))
        # texts of class 1 as often as the rest, up to twice; one in twenty is the empty window
        chosen = np.concatenate([pool, np.repeat(ones, min(weigh, 2)), np.full(len(pool) // 20 + 1, len(start) - 1)])
        for _ in range(epochs):
            mixed = rng.permutation(chosen)
            for lo in range(0, len(mixed), batch):
                part = mixed[lo : lo + batch]
                g = net.gradients(known, *x.fill(start[part], text[part]), y[text[part]])
                step += 1
                for k, v in p.items():
                    m = moment[k]
                    m[0] += 0.1 * (g[k] - m[0])
                    m[1] += 0.001 * (g[k] * g[k] - m[1])
                    v -= rate * (m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8) + decay * v)
    return net


def score(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_fold: int = 0,
    sample: int = 1000,
    longest: int = 16384,
    **options,
) -> DataFrame:
    """(id, held_out, score) of every row; rows with crc32(id) mod folds = held_fold teach nothing."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(bucket(F.col("id"), folds) == held_fold, F.lit(False)))
    taught = labels.select(col(id_col).alias("_id"), col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    key = F.xxhash64("text").alias("key")
    short = rows.where(~F.col("held_out") & (F.octet_length("text") <= longest)).select("id", key)
    # ids and hashes only are joined and ranked; the few chosen rows then fetch their texts
    taught = short.join(taught, F.col("id") == F.col("_id")).select("id", "key", "y").distinct()
    taught = taught.withColumn("order", F.xxhash64(F.col("id").cast("string"), F.lit(13)))
    held = [taught.where(F.col("y") == k).orderBy("order", "id", "key").limit(sample) for k in (0, 1)]
    held = keep(held[0].unionAll(held[1]), "sample")
    held = rows.select("id", key, "text").join(F.broadcast(held), ["id", "key"]).dropDuplicates(["id", "key", "y"])
    held = held.coalesce(1).sortWithinPartitions("y", "order", "id", "text").select("text", "y")

    def fit(batches):
        texts, y = [], []
        for b in batches:
            texts += utf8(b.column(0))
            y += b.column(1).to_pylist()
        share = sum(y) / len(y) if y else 0.5
        net = train(texts, np.array(y), **options) if 0 < share < 1 else None
        yield pa.RecordBatch.from_arrays([pa.array([share]), pa.array([pickle.dumps(net)])], names=["share", "net"])

    # a table, so that the weights are fitted once
    model = keep(held.mapInArrow(fit, "share double, net binary"), "network").first()
    share = model["share"] if model else 0.5
    shared = docs.sparkSession.sparkContext.broadcast(pickle.loads(model["net"]) if model else None)

    def run(batches):
        for b in batches:
            net = shared.value
            out = net.score(utf8(b.column(2))) if net else np.full(b.num_rows, share)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["id", "held_out", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, score double")
