"""The pipeline's stages on a small corpus with planted cases, and run() against the stages."""

from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from factloom.llm import packing
from tests_llm_helpers import brute_near_duplicates


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    planted = spark.createDataFrame([(10_001, "1234 5678 --", "en", "s", 12), (10_002, None, "en", "s", 0), (10_003, "write to anna.bell@example.com now please", "en", "s", 40), (10_004, "write to anna.bell@example.com now please", "en", "s", 40)], docs.schema)
    docs = docs.unionByName(planted)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, data), f"test-{name}")
        if name != "packing":
            assert docs.columns == before.columns
        if name == "language":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == {10_001, 10_002}
        if name == "near_duplicates":
            kept = {r.doc_id for r in docs.collect()}
            assert kept == brute_near_duplicates([(r.doc_id, r.text) for r in before.collect()])
        if name == "personal_data":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert text[10_003] == "write to [EMAIL] now please" and 10_004 not in text
            plain = {r.doc_id: r.text for r in before.collect() if not any(c in r.text for c in "0123456789@")}
            assert all(text[i] == t for i, t in plain.items())
    model = packing.WordTokenizer(packing.word_bpe_path())
    ids = {r.doc_id: np.append(np.frombuffer(model.encode(r.text), "<u4"), 2) for r in before.collect()}
    rows = docs.collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length].tolist() and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_run_is_the_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, data), f"test-{name}")
    both = [sorted((r.doc_id, r.start, r.ids_crc32, r.sequence_id) for r in d.collect()) for d in (docs, corpus_pipeline.run(spark, data))]
    assert both[0] == both[1]


def test_empty_and_null_rows(spark, data):
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0
    odd = spark.createDataFrame([(None, "the cat sat on the mat", None, None, None), (None, "the cat sat on the mat", None, None, None), (1, "the cat sat on the mat", None, None, None), (2, None, None, None, None), (None, "another text altogether, of other words", None, None, None)], empty.schema)
    kept = corpus_pipeline.remove_near_duplicates(spark, odd, data).collect()
    assert sorted(str(r.text) for r in kept) == ["None", "another text altogether, of other words", "the cat sat on the mat"]
