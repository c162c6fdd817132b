"""Near-duplicates by SimHash: fingerprints, links within a Hamming radius found with BK-trees, groups.

A fingerprint has 64 bits. Texts are lower-cased (A-Z), cut into words at
ASCII white space and into shingles of neighbouring words, repeats included; a
bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42). A
shorter text is one shingle; a text without words (null, empty, blank) has
fingerprint zero, which links like any other.

Fingerprints within the radius are linked, and a group is a connected
component. The search is whole: bits are cut into ``blocks``; two fingerprints
with at most ``radius`` differing bits agree on at least ``blocks - radius`` of
them, so each fingerprint goes to one shard for every choice of that many
blocks, and every linked pair meets in a shard. Each shard has its BK-tree,
searched by the shard's fingerprints. Shards of over ``chunk`` members are cut
into chunks, and each chunk's tree is searched by every chunk, one pair of
chunks a task group, so memory is bounded by the chunk. A tree's task returns
for each member the smallest member that it reaches there, not all pairs.

Cases: rows with a null id take part and never name a group unless no other row
does; repeated rows get the same result; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.llm.bktree import Forest, smallest_linked
from edgeline.llm.common import col, keep, lean, utf8
from edgeline.llm.components import components

BITS = 64


def simhash(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends])[: len(words) - shingle + 1].tolist()
    parts = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        # little-endian bytes, lowest bit first: position j is bit j
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, text_key, bits): SimHash of every whole text as a signed 64-bit number; text_key tells texts apart."""

    def run(batches):
        for b in batches:
            h = np.array([simhash(t, shingle) for t in utf8(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h)], names=["id", "text_key", "bits"])

    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("text_key"), col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, text_key long, bits long")


def _masks(blocks: int, agree: int) -> list[int]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(one[i] for i in pick) for pick in combinations(range(blocks), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, chunk: int = 2048) -> DataFrame:
    """(a, b) links of distinct fingerprints ``bits`` whose components are those of all pairs within ``radius``."""
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    masks = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("mask")) for i, m in enumerate(_masks(blocks, blocks - radius))])
    shards = prints.select("bits", F.explode(masks).alias("m")).select(
        "bits", F.xxhash64("m.no", F.col("bits").bitwiseAND(F.col("m.mask"))).alias("shard")
    )
    sizes = shards.groupBy("shard").agg(F.count("*").alias("members")).where("members > 1")
    rows = shards.join(sizes, "shard")
    # chunk pairs (i <= j): the tree of chunk i, searched by chunk j
    rows = rows.withColumn("chunks", F.ceil(F.col("members") / chunk).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("pair"),
        (F.col("own") <= F.col("other")).alias("tree"),
        (F.col("own") >= F.col("other")).alias("query"),
        "bits",
    )

    def solve(pair, tree, query, bits):
        inside = np.flatnonzero(tree)
        forest = Forest(bits[inside], pair[inside])
        ask = np.flatnonzero(query)
        # a pair's rows are neighbours, so its tree begins at the first tree row of the pair
        root = np.searchsorted(pair[inside], pair[ask])
        a, b = [], []
        for q, t in forest.search(bits[ask], root, radius):
            i, j = ask[q], inside[t]
            a.append(i[i != j])
            b.append(j[i != j])
        if not a:
            return np.empty((0, 2), np.int64)
        a, b = np.concatenate(a), np.concatenate(b)
        low = smallest_linked(len(bits), a, b, np.arange(len(bits)))
        moved = np.flatnonzero(low != np.arange(len(bits)))
        return np.stack([bits[moved], bits[low[moved]]], 1).view(np.int64)

    def run(batches):
        held = None
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut < 8192:
                continue
            out = solve(*[x[:cut] for x in (*held[:3], held[3].view(np.uint64))])
            held = [x[cut:].copy() for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])
        if held is not None and len(held[0]):
            out = solve(*held[:3], held[3].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(lean(run), "a long, b long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    blocks: int = 6,
    chunk: int = 2048,
) -> DataFrame:
    """(id, text_key, bits, group, component_id) for every row; component_id is the smallest id of its group."""
    prints = keep(fingerprints(docs, id_col, text_col, shingle), "simhash")
    roots = components(links(prints.select("bits").distinct(), radius, blocks, chunk))
    rows = prints.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
    rows = rows.withColumn("group", F.coalesce("root", "bits"))
    names = rows.groupBy("group").agg(F.min("id").alias("component_id"))
    return rows.join(names, "group").select("id", "text_key", "bits", "group", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every near-duplicate group, all columns: that of the smallest id.

    Rows of the same id but different texts are told apart by text; of rows
    equal in id and text one stays. Rows with a null id stay only where a
    group has no other.
    """
    named = near_groups(docs, id_col, text_col, **options)
    first = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_key")).alias("m"))
    first = first.select(F.col("m.id").alias("_keep_id"), F.col("m.text_key").alias("_keep_key"))
    rows = docs.withColumn("_text_key", F.xxhash64(col(text_col)))
    match = col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_text_key") == F.col("_keep_key"))
    return rows.join(first, match, "left_semi").dropDuplicates([id_col, "_text_key"]).drop("_text_key")
