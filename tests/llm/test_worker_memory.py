"""What operators leave, and hold, in reused Python workers."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from voxelith.llm import fast_sketch_dedup, text, word_backoff_language

SCHEMA = "doc_id bigint, text string, lang string"


def batch_of(texts: list[str]) -> pa.RecordBatch:
    rows = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts), pa.array(["en"] * rows)], names=["id", "text", "lang"])


@pytest.fixture
def tasks(spark, monkeypatch):
    """The functions that the operators give to ``mapInArrow``, instead of their tables."""
    docs = spark.createDataFrame([(1, "some words of a text", "en")], SCHEMA)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    model = word_backoff_language.Model(["en"])
    return {
        "language": word_backoff_language.predict(docs, model),
        "sketch": fast_sketch_dedup.sketch_documents(docs, "doc_id", "text", 5),
        "groups": lambda batches: fast_sketch_dedup._grouped(batches, ["id"]),
    }


@pytest.mark.parametrize("name", ["language", "sketch", "groups"])
def test_memos_of_other_operators_are_dropped(tasks, monkeypatch, name):
    monkeypatch.setattr(text, "_MEMOS", {1: object()})
    assert list(tasks[name](iter([batch_of(["a b c d e f", "a b"])])))
    assert not text._MEMOS


def test_sketching_holds_little_beside_the_batch(tasks):
    """A batch as large as Spark makes them."""
    rng = np.random.default_rng(1)
    words = np.array([f"word{k}" for k in range(5000)])
    batch = batch_of([" ".join(words[rng.integers(0, len(words), 500)]) for _ in range(2000)])
    assert 7 << 20 < batch.nbytes < 10 << 20
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in tasks["sketch"](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == batch.num_rows
    assert peak < 32 << 20
