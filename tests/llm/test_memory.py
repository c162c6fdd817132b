"""What a worker still holds of an executor's memory when its task is over."""

import random
import re
from collections import deque
from pathlib import Path

import pyarrow as pa
import pytest
from fixtures_path import fixtures as fx
from pyspark.sql import functions as F

from edgeline.llm import common, packing, quality
from edgeline.llm.queries import word_tokenizer

STAGES = {
    "quality": lambda docs: quality.score(docs, docs.select("doc_id", F.lit(1).alias("quality"))),
    "packing": lambda docs: packing.pieces(docs, word_tokenizer()),
}
MEMORY = Path("/proc/self/smaps_rollup")


def held() -> float:
    """MB of this process alone."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", MEMORY.read_text())[1]) / 1024


@pytest.mark.skipif(not MEMORY.exists(), reason="the memory of a process can't be read here")
@pytest.mark.parametrize("stage", STAGES)
def test_a_task_gives_its_memory_back(spark, monkeypatch, stage):
    """20 MB of text in one task; what stays is the tokenizer, the words it knows and the hashes' powers."""
    tasks = []
    frame = type(spark.range(0))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a: tasks.append(f) or real(self, f, *a))
    STAGES[stage](fx.frame(spark, fx.messy_rows()))
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=700)) for _ in range(5_000)]
    ids = pa.array(range(len(texts)), pa.int64())
    columns = [ids, pa.array(texts)] if stage == "packing" else [ids, ids, pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
    common.give_back()
    before = held()
    pins = deque()  # memory taken while the task runs keeps the heap from shrinking by itself
    for _ in tasks[0](iter([batch, batch])):
        pins.append(bytearray(1000))
    assert held() - before < 40
