from pyspark.sql import functions as F

from edgeline.llm import katz
from edgeline.llm.common import WRITERS, keep
from fixtures_path import fixtures as fx


def test_one_value_reads_its_own_files_only(spark):
    rows = spark.range(60, numPartitions=2).select((F.col("id") % 3).cast("int").alias("kind"), "id")
    before = spark.conf.get(WRITERS, "0")
    kept = keep(rows, "apart", apart=("kind", 3))
    assert spark.conf.get(WRITERS, "0") == before
    assert kept.schema.names == ["kind", "id"]
    assert sorted(map(tuple, kept.collect())) == sorted((i % 3, i) for i in range(60))
    one = kept.where("kind = 1")
    assert sorted(r["id"] for r in one.collect()) == list(range(1, 60, 3))
    assert one.select(F.input_file_name()).distinct().count() < kept.select(F.input_file_name()).distinct().count()
    assert keep(rows.where("id < 0"), "apart", apart=("kind", 3)).count() == 0


def test_counted_rows_lie_apart(spark, monkeypatch):
    """Of what the bigrams' counts give, each step reads its own kind."""
    tables = []
    real = katz.keep
    monkeypatch.setattr(katz, "keep", lambda df, label, **o: tables.append((label, o)) or real(df, label, **o))
    katz.score_texts(fx.frame(spark, fx.messy_rows())).count()
    assert [o["apart"] for label, o in tables if label == "counted"] == [("kind", katz.COUNT + 1)] * 2
