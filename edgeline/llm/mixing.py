"""Mixing sources to target weights by subset-sum budget fitting.

Sources share the budget by weight; a source gives at most ``repeats`` times its
size, and the excess is shared again by weight until no target is above. A
source's target is then met from whole documents: every document as many times
as the source fits in full, and once more a subset of the remaining budget:

1. documents are counted by source and exact size;
2. the budget is spread over the sizes in proportion, rounded down, so that the
   subset looks like the source;
3. what rounding left is filled with the largest sizes that fit down to
   ``window`` words, and bounded-knapsack dynamic programming over the sizes
   still available finds a sum that meets the rest exactly, or comes nearest
   from below;
4. of each size so many documents are taken, in the order of a seeded hash.

The counts of a source are bounded by its distinct sizes; sources are solved
apart, as groups of that table. Documents are numbered within (source, size) in
cells, so one source or one size may hold any share of the rows.

Cases: null text has size 0; documents of size 0 are taken as often as the
source in full (they cost nothing); a null source is a source, the last; equal
rows are alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import col, keep, rank_in_groups


def words(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], repeats: float, budget: float | None = None) -> list[float]:
    """Shares of the budget by weight, none above ``repeats`` times its size while another has room."""
    budget = float(sum(sizes)) if budget is None else budget
    goal = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = budget
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > repeats * sizes[i]]
        if not full:
            for i in open_:
                goal[i] = weights[i] * unit
            break
        for i in full:
            goal[i] = float(repeats * sizes[i])
            left -= goal[i]
        open_ = [i for i in open_ if i not in set(full)]
    return goal


def fit(counts: dict[int, int], budget: int, window: int = 16384) -> dict[int, int]:
    """How many pieces of each size to take so that their sum meets ``budget`` or comes nearest from below."""
    counts = {s: c for s, c in counts.items() if s > 0 and c > 0}
    whole = sum(s * c for s, c in counts.items())
    if budget >= whole:
        return counts
    take = {s: budget * c // whole for s, c in counts.items()}
    left = budget - sum(s * k for s, k in take.items())
    for s in sorted(counts, reverse=True):
        if left > window and s <= left:
            more = min(counts[s] - take[s], (left - window) // s + 1, left // s)
            take[s] += more
            left -= more * s
    # reachable sums as bits, size after size, until the rest is met
    reach, steps = 1, []
    limit = (1 << (left + 1)) - 1
    for s in sorted(counts):
        free = min(counts[s] - take[s], left // s)
        if not free:
            continue
        steps.append((s, free, reach))
        part = 1
        while free:
            k = min(part, free)
            reach |= (reach << (s * k)) & limit
            free -= k
            part <<= 1
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for s, free, before in reversed(steps):
        for k in range(free + 1):
            if at - k * s >= 0 and before >> (at - k * s) & 1:
                take[s] += k
                at -= k * s
                break
    return take


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    repeats: int = 3,
    seed: int = 17,
    window: int = 16384,
) -> DataFrame:
    """(id, text_key, source, size, source_size, target, times) of every row; ``times`` is how often the mix takes it.

    ``weights`` go to the sources by code point, null last, and repeat.
    """
    rows = docs.select(
        col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("text_key"), col(source_col).alias("source"),
        words(col(text_col)).alias("size"),
    )
    rows = keep(rows.withColumn("draw", F.xxhash64(F.lit(seed), "id", "text_key")), "sizes")
    counts = keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    # one row a source
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["total"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], repeats)
    plan = [
        (r["source"], r["total"], g, int(min(repeats, g // r["total"])) if r["total"] else 1)
        for r, g in zip(totals, goal, strict=True)
    ]
    kind = rows.schema["source"].dataType.simpleString()
    plan = docs.sparkSession.createDataFrame(plan, f"source {kind}, source_size long, target double, full int")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        rest = int(round(first["target"])) - int(first["full"]) * int(first["source_size"])
        take = fit(dict(zip(group["size"].tolist(), group["n"].tolist(), strict=True)), max(0, rest), window)
        return group[["source", "size", "source_size", "target", "full"]].assign(extra=[take.get(s, 0) for s in group["size"].tolist()])

    named = counts.join(plan, counts["source"].eqNullSafe(plan["source"])).select(counts["source"], "size", "n", "source_size", "target", "full")
    quota = named.groupBy("source").applyInPandas(
        choose, f"source {kind}, size long, source_size long, target double, full int, extra long"
    )
    quota = keep(quota.withColumnsRenamed({"source": "_source", "size": "_size"}), "quota")
    ranked = rank_in_groups(rows, ["source", "size"], ["draw", "id", "text_key"], "_rank")
    out = ranked.join(quota, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    return out.withColumn("times", (F.col("full") + (F.col("_rank") < F.col("extra")).cast("int")).cast("int")).select(
        "id", "text_key", "source", "size", "source_size", "target", "times"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, all columns, each as often as it is taken."""
    plan = keep(plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options), "mix")
    # rows equal in id, text and source are alike: theirs are added up and dealt out as one
    plan = plan.groupBy("id", "text_key", "source").agg(F.sum("times").alias("_times")).where("_times > 0")
    plan = plan.withColumnsRenamed({"id": "_id", "text_key": "_key", "source": "_source"})
    rows = docs.withColumn("_text", F.xxhash64(col(text_col)))
    rows = rows.dropDuplicates([id_col, "_text", source_col])
    match = col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")) & col(source_col).eqNullSafe(F.col("_source"))
    out = rows.join(plan, match).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return out.select(*[col(c) for c in docs.columns])
