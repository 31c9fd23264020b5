"""Streams that stop and go on from their checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.streaming import jobs


def test_an_upsert_goes_on_from_its_state(spark, tmp_path):
    """Two runs on one home over input that grows: old versions that come late lose, the second run reads new files only, and a third changes nothing."""
    source, home = str(tmp_path / "in"), str(tmp_path / "home")
    schema = "k long, kind string, v long, text string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: {(r.k, r.kind): (r.v, r.text) for r in jobs.upsert_stream(spark.readStream.schema(schema).parquet(source), ["k", "kind"], "v", home).collect()}
    sizes = lambda: [r.n for r in spark.read.parquet(f"{home}/changes").groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    write([(1, "a", 5, "five"), (2, "a", 1, "one"), (1, "a", 3, "three"), (None, "a", 1, None)])
    assert run() == {(1, "a"): (5, "five"), (2, "a"): (1, "one"), (None, "a"): (1, None)} and sizes() == [3]
    write([(1, "a", 4, "late"), (2, "a", 2, "two"), (3, "b", 1, "new"), (2, "a", 2, "three")])
    state = {(1, "a"): (5, "five"), (2, "a"): (2, "two"), (3, "b"): (1, "new"), (None, "a"): (1, None)}
    assert run() == state and sizes() == [3, 3]  # what the second batch saw; not the whole state
    assert run() == state and sizes() == [3, 3]


def test_the_same_input_in_many_batches(spark, tmp_path):
    """A file a batch, or all at once: the same state."""
    source = str(tmp_path / "in")
    rows = [(i % 7, (i * 37) % 101, f"t{i}") for i in range(300)]
    spark.createDataFrame(rows, "k long, v long, text string").repartition(6).write.parquet(source)
    once = jobs.upsert_stream(spark.readStream.schema("k long, v long, text string").parquet(source), ["k"], "v", str(tmp_path / "a"))
    each = jobs.upsert_stream(spark.readStream.schema("k long, v long, text string").option("maxFilesPerTrigger", 1).parquet(source), ["k"], "v", str(tmp_path / "b"))
    best = {}
    for k, v, t in rows:
        best[k] = max(best.get(k, (v, t)), (v, t))
    assert {r.k: (r.v, r.text) for r in once.collect()} == {r.k: (r.v, r.text) for r in each.collect()} == best
