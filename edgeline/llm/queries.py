"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline.llm import (
    ann,
    centroids,
    fingerprints,
    katz,
    mixing,
    neardup,
    packing,
    passages,
    quality,
    sharding,
    suffixes,
    toxicity,
    whitening,
)
from edgeline.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(documents(spark, sf_dir), word_tokenizer(), with_ids=False)
    return out.withColumnRenamed("id", "doc_id")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), shards=24).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir), weights=(1, 2, 3), repeats=3).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        fingerprints.hex16(F.col("bits")).alias("fingerprint"),
        fingerprints.hex16(F.col("edited_bits")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(documents(spark, sf_dir), shingle=4, radius=4).select(
        F.col("id").alias("doc_id"), fingerprints.hex16(F.col("bits")).alias("fingerprint"), "component_id"
    )


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scores.select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0, k=20)


@query
def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(documents(spark, sf_dir), length=50).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(documents(spark, sf_dir), min_words=50, shingle=5, similarity=0.8).withColumnsRenamed(
        {"id": "doc_id", "other": "other_id"}
    )


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, dims=64, scale=256, seed="2")
    return out.withColumnRenamed("id", "vec_id")


def clustering_sql(clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> str:
    """The same assignment by comparing every vector with every centroid, a subquery for each round."""
    wide = "HUGEINT"

    def assigned(centres: str) -> str:
        # one row per vector and centroid; the nearest by (distance, number)
        return f"""SELECT vec_id, r, v, min(d * {clusters} + cluster) AS best FROM (
    SELECT k.vec_id, k.r, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda p: CAST(p[1] - p[2] AS {wide}) * (p[1] - p[2]))) AS d
    FROM kept k, {centres} c) GROUP BY vec_id, r, v"""

    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({assigned(f'c{i}')})")
        steps.append(f"""m{i} AS (SELECT cluster, i, (s - ((s % n) + n) % n) // n AS x FROM (
  SELECT best % {clusters} AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {dims} + 1) t(i) GROUP BY ALL))""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (
  SELECT cluster, list(CAST(x AS BIGINT) ORDER BY i) AS v FROM m{i} GROUP BY cluster) n ON n.cluster = c.cluster)""")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (
  SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {clusters})),
{", ".join(steps)},
last AS ({assigned(f"c{rounds}")}),
found AS (SELECT vec_id, CAST(best % {clusters} AS INTEGER) AS cluster, CAST(best // {clusters} AS BIGINT) AS distance FROM last)
SELECT vec_id, f.cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM found f JOIN c{rounds} c ON c.cluster = f.cluster"""


ORACLES["op11_centroid_clustering"] = clustering_sql()


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16, scale=64, shift=1_000_000).withColumnRenamed("id", "vec_id")


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scores.select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
