"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor kept and returns documents, all
columns; the last returns packed pieces. Between stages the rows are written as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline.llm import mixing, neardup, packing, passages, quality
from edgeline.llm.common import documents, keep
from edgeline.llm.queries import table, word_tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return neardup.drop_near_copies(docs, shingle=4, radius=4)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that near-duplicate an earlier document's."""
    out = passages.drop_passages(docs, min_words=50, shingle=5, similarity=0.8)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the sources' weights, repeated up to three times."""
    return mixing.mix(docs, weights=(1, 2, 3), repeats=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, word_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", drop_passages),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: The stages need trained scores, BK-trees, compact windows and a tokenizer: no SQL, tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, "stage")
    return docs
