import sys
from pathlib import Path

import pytest
from fixtures_path import fixtures as fx

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from edgeline.llm import neardup, packing, quality
from edgeline.llm.queries import word_tokenizer
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_stand_in_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing sources to target weights", "best-fit packing"]


def test_every_stage_acts_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.score(source, labels).where("score >= 0.3")
    ids = lambda df, c="doc_id": sorted(r[0] for r in df.select(c).collect())
    assert ids(kept[0]) == ids(good, "id")
    groups = neardup.near_groups(kept[0])
    assert ids(kept[1]) == sorted({r["component_id"] for r in groups.collect()})
    before, after = ({r["doc_id"]: r["text"] for r in k.collect()} for k in (kept[1], kept[2]))
    assert set(after) <= set(before)
    for i, text in after.items():
        assert len(text) <= len(before[i])
        assert set(text.split()) <= set(before[i].split())
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].collect())
    mixed = [(r["doc_id"], r["text"]) for r in kept[3].collect()]
    assert {i for i, _ in mixed} <= set(after)
    assert max(mixed.count(m) for m in mixed[:50]) <= 3
    pieces = kept[4].collect()
    want = [len(x) // 4 + 1 for x in packing.encode([t for _, t in mixed], word_tokenizer())]
    assert sum(r["length"] for r in pieces) == sum(want)
    room = {}
    for r in pieces:
        assert len(r["ids"]) == r["length"]
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("clash", [False, True])
def test_stages_take_messy_rows(spark, tmp_path, clash):
    docs = fx.frame(spark, fx.messy_rows(), clash).drop("a.b")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() > 0


def test_stages_take_no_rows(spark, tmp_path):
    docs = fx.empty(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() == 0


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "ids"} <= set(rows.columns)
    assert rows.agg(F.max("length")).first()[0] <= 2048
