"""The pipeline against a brute-force version, and its stages on the awkward small table."""

import collections

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import fixtures as fx
from voxelith.llm.queries import tokenizer_path

ROOT = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    """What each stage keeps, from that stage's own input."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    judged = corpus_pipeline.language(spark, docs, ROOT)
    texts = {r.doc_id: r.text for r in judged.collect()}
    assert set(texts) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}

    label = fx.components(texts.items(), size=5)
    texts = {i: t for i, t in texts.items() if label[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    bad = fx.contamination(texts.items(), items)
    texts = {i: t for i, t in texts.items() if i not in bad}
    assert bad and len(texts) < len(label)

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    secret = {i for i, t in texts.items() if any(fx.spans(t, k) for k in ("assign", "access", "hex"))}
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items() if i not in secret}
    got = corpus_pipeline.run(spark, ROOT).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.n == r["all"] for r in got)
    assert {r.doc_id: r.n for r in got if r.doc_id not in secret} == want


def test_secrets_are_gone(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    changed = 0
    for r in corpus_pipeline.secrets(spark, docs, ROOT).collect():
        for kind in ("assign", "access", "hex"):
            assert not fx.spans(r.text, kind)
            changed += bool(fx.spans(before[r.doc_id].text, kind))
        assert r.n_chars == len(r.text)
        if not any(fx.spans(before[r.doc_id].text, k) for k in ("assign", "access", "hex")):
            assert r == before[r.doc_id] or "[" in r.text
    assert changed


def test_stages_stand_awkward_tables(spark):
    for docs in (fx.documents(spark), fx.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, ROOT)
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.collect()


def test_one_row_of_a_repeated_document_stays(spark):
    kept = collections.Counter(r.doc_id for r in corpus_pipeline.near_copies(spark, fx.documents(spark), ROOT).collect())
    assert max(kept.values()) == 1 and {1, 5, 6, 7, 12, 19} <= set(kept) and not {3, 14} & set(kept)


def test_stages_are_as_asked(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "benchmark", "secrets", "packing"]


def test_rows_of_one_id_with_different_texts_stay(spark):
    data = [(1, fx.story(1, 40)), (1, fx.story(2, 40)), (1, fx.story(2, 40)), (2, "word")]
    got = sorted(tuple(r) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(data, "doc_id bigint, text string"), ROOT).collect())
    assert got == sorted(set(data))
