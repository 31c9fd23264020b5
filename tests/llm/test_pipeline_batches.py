"""What a stage of the pipeline sends to Python at a time."""

import pyarrow as pa

import corpus_pipeline as C


def test_stages_send_small_batches(spark):
    def largest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    docs = spark.range(0, 64, 1, 1).selectExpr("id as doc_id", "repeat('ten bytes ', 20000) as text")
    stage = C._shared(lambda spark, docs, sf: docs.mapInArrow(largest, "size long"))
    try:
        assert max(r.size for r in stage(spark, docs, "").collect()) < 3_000_000  # 12.8 MB in all
        spark.conf.set(C.BATCH_SETTING, 64 << 20)  # what the session says holds
        assert max(r.size for r in stage(spark, docs, "").collect()) > 12_000_000
    finally:
        spark.conf.unset(C.BATCH_SETTING)
