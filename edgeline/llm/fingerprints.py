"""Document fingerprints: SimHash of weighted terms, and search within a Hamming radius by permuted block tables.

Terms are shingles of ``shingle`` neighbouring words (the whole sequence, if
shorter), A-Z lowered; a term that occurs n times has the weight 1 + ln n. Each
term's 64-bit hash votes on every bit with its weight, for it where its bit is 1
and against it where it is 0; a fingerprint bit is 1 where the votes are
positive. A text without words has fingerprint zero.

Two fingerprints' likeness is 1 - differing bits / 64.

Search: bits are cut into blocks; fingerprints with at most ``radius`` differing
bits agree on ``blocks - radius`` whole blocks. For every such choice there is a
table with these blocks moved to the front as its key, and a join on the key
finds all pairs within the radius.

Cases: null text is empty; the follower of a document is the next by id, of the
last the first, and rows of equal id follow each other by text hash; rows with a
null id come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import Words, col, keep, slices, utf8

BITS = 64


def weighted_simhash(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Fingerprints of texts as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in slices(texts):
        w = Words(texts[lo:hi])
        terms, at = w.shingles(shingle)
        doc = w.doc[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < shingle))
        if len(short):
            whole = np.array([np.bitwise_xor.reduce(w.hash[w.first[d] : w.first[d + 1]] * (np.arange(w.counts[d], dtype=np.uint64) * np.uint64(2) + np.uint64(1))) for d in short], np.uint64)
            terms, doc = np.concatenate([terms, whole]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            terms, doc = terms[order], doc[order]
        begin = np.searchsorted(doc, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            mine = terms[begin[d] : begin[d + 1]]
            if not len(mine):
                continue
            mine, n = np.unique(mine, return_counts=True)
            votes = np.zeros(BITS)
            plain = n == 1
            for i in range(0, len(mine), 8192):
                bits = np.unpackbits(mine[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                often = np.flatnonzero(~plain[i : i + 8192])
                votes += 2.0 * bits.sum(0, dtype=np.int64) - len(bits)
                if len(often):
                    extra = np.log(n[i : i + 8192][often])
                    votes += extra @ (2.0 * bits[often] - 1.0)
            out[lo + d] = np.packbits(votes > 0, bitorder="little").view(np.uint64)[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b) / BITS


def hex16(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, rows_a_part: int = 4096) -> DataFrame:
    """(id, n_chars, edited_sha256, bits, edited_bits, near_edited, near_next) of every row.

    The edited text has its last half replaced by the first as many code points
    of the next text. Texts are dealt once, by ranges of id; the first row of a
    range also goes to the range before, as the follower of its last row.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    ids = keep(rows.select("id", "key"), "ids")
    count = ids.count()
    parts = max(1, min(-(-count // rows_a_part), 1 << 16))
    cuts = [] if count == 0 else sorted({r["id"] for r in _sampled(ids, parts * 32).collect() if r["id"] is not None})
    cuts = sorted({cuts[len(cuts) * i // parts] for i in range(1, parts)}) if cuts else []
    kind = rows.schema["id"].dataType.simpleString()
    def parted(df: DataFrame) -> DataFrame:
        edges = np.array(cuts, dtype=object if cuts and isinstance(cuts[0], str) else None)
        names = df.columns

        def run(batches):
            for b in batches:
                at = names.index("id")
                got = b.column(at).to_pandas()
                p = np.zeros(len(got), np.int32)
                there = got.notna().to_numpy()
                if len(edges):
                    p[there] = np.searchsorted(edges, got[there].to_numpy(), "right")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "part"])

        return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", part int")

    firsts = parted(ids).groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("there"), "id", "key")).alias("f"))
    firsts = sorted(firsts.select("part", "f.id", "f.key").collect(), key=lambda r: r["part"])
    # the first row of each part follows the last row of the part before; the very first follows the last
    follows = [(r["id"], r["key"], firsts[i - 1]["part"], r["part"]) for i, r in enumerate(firsts)]
    lent = F.broadcast(spark.createDataFrame(follows, f"_id {kind}, _key long, _to int, _own int").withColumn("_lent", F.lit(True)))
    dealt = parted(rows)
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_own"))
    dealt = dealt.join(lent, match, "left")
    copies = F.when(
        F.col("_lent"), F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("p"), F.lit(True).alias("guest")))
    ).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("guest"))))
    dealt = dealt.withColumn("c", F.explode(copies)).select(F.col("c.p").alias("p"), F.col("c.guest").alias("guest"), "id", "key", "text")
    dealt = dealt.repartition(max(1, len(firsts)), "p").sortWithinPartitions("p", "guest", "id", "key")
    out = "id {}, n_chars long, edited_sha256 string, bits long, edited_bits long, near_edited double, near_next double".format(kind)
    names = [x.split()[0] for x in out.split(", ")]

    def score(ids_: pa.Array, texts: list[str], after: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after, strict=True)]
        new = [e.encode() for e in edited]
        mine = weighted_simhash([t.encode() for t in texts], shingle)
        # a row's follower is mostly the next row, whose fingerprint is known
        same = [i + 1 < len(texts) and after[i] is texts[i + 1] for i in range(len(texts))]
        other = np.concatenate([mine[1:], mine[:1]])
        odd = [i for i, s in enumerate(same) if not s]
        other[odd] = weighted_simhash([after[i].encode() for i in odd], shingle)
        changed = weighted_simhash(new, shingle)
        cols = [
            ids_, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in new]),
            pa.array(mine.view(np.int64)), pa.array(changed.view(np.int64)),
            pa.array(likeness(mine, changed)), pa.array(likeness(mine, other)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        held = None  # (part, id, text) that waits for its follower
        for b in batches:
            p, guest = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids_, texts = b.column(2), b.column(4).to_pylist()
            own, next_, who = [], [], []
            if held is not None:
                own.append(held[2])
                who.append(held[1])
                next_.append(texts[0])
            whole = [i for i in range(len(p) - 1) if not guest[i]]
            own += [texts[i] for i in whole]
            next_ += [texts[i + 1] for i in whole]
            taken = ids_.take(pa.array(whole, pa.int64()))
            column = pa.concat_arrays([*who, taken])
            held = None if guest[-1] else (p[-1], ids_.slice(len(p) - 1, 1), texts[-1])
            for i in range(0, len(own), 512):
                yield score(column.slice(i, 512), own[i : i + 512], next_[i : i + 512])

    return dealt.mapInArrow(run, out)


def _sampled(ids: DataFrame, size: int) -> DataFrame:
    """About ``size`` ids, drawn by hash: boundaries need no more, whatever the number of rows."""
    n = max(1, ids.count())
    share = min(1.0, size / n)
    return ids.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)) + 1)).select("id")


def within_radius(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance): all pairs a < b of distinct fingerprints ``bits`` within ``radius``, by permuted block tables."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(one[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    rows = prints.select("bits").distinct().withColumn("m", F.explode(table))
    rows = rows.select("bits", F.col("m.no").alias("no"), F.col("bits").bitwiseAND(F.col("m.mask")).alias("front"))
    a, b = rows.withColumnRenamed("bits", "a"), rows.withColumnRenamed("bits", "b")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = a.join(b, ["no", "front"]).where("a < b").withColumn("distance", distance)
    return pairs.where(F.col("distance") <= radius).select("a", "b", "distance").distinct()
