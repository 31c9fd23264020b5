"""Readers and landing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.sources import html, snapshots
from factloom.streaming import jobs


def test_html_articles():
    title, body, links = html.parse('<html><head><title> A  b </title><script>x()</script></head><body><nav><a href="/n">menu</a></nav><h1>Head</h1><p>One &amp; two</p><p><a href="/x">three</a></p></body></html>')
    assert (title, body, links) == ("A b", "Head\nOne & two\nthree", ["/n", "/x"])
    assert html.parse(None) == ("", "", [])


def test_list_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("full_name,birth_date\nAnna Bell,1980-01-01\n")
    (tmp_path / "a.json").write_text('{"full_name": "Anna Bell"}\n')
    (tmp_path / "a.xml").write_text("<list><entry><full_name>Anna Bell</full_name></entry></list>")
    (tmp_path / "a.html").write_text("<ol><li>Anna Bell</li><li>Bob Stone</li></ol>")
    for kind in ("csv", "json", "xml"):
        assert snapshots.read_list(spark, f"{tmp_path}/a.{kind}", kind).first().full_name == "Anna Bell"
    assert [r.text for r in snapshots.read_list(spark, f"{tmp_path}/a.html", "html").orderBy("line").collect()] == ["Anna Bell", "Bob Stone"]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><guid>g1</guid><link>http://x/1</link><title> T </title><pubDate>Mon, 06 Sep 2021 10:00:00 +0000</pubDate><description>d</description></item>"
        "<item><link>http://x/2</link><title>U</title><pubDate>soon</pubDate><description>e</description></item></channel></rss>"
    )
    rows = snapshots.read_feed(spark, f"{tmp_path}/f.xml").orderBy("url").collect()
    assert [(r.external_id, r.title, str(r.published_at)) for r in rows] == [("g1", "T", "2021-09-06 10:00:00"), ("http://x/2", "U", "None")]


def test_upsert_and_tombstones(spark):
    stored, arrived = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, t string"), spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 1, "e")], "k int, v int, t string")
    assert sorted(map(tuple, snapshots.upsert(stored, arrived, ["k"], "v").collect())) == [(1, 2, "c"), (2, 5, "d"), (3, 1, "e")]
    docs = spark.createDataFrame([(1, bytearray(b"x"), "text"), (2, bytearray(b"y"), "text")], "k int, c binary, content_type string")
    assert sorted((r.k, bytes(r.c), r.content_type) for r in snapshots.tombstones(docs, F.col("k") == 2, "c").collect()) == [(1, b"x", "text"), (2, b"", "expired")]


def test_sync_is_unsafe_when_most_is_gone(spark):
    old, few = spark.range(10).withColumnRenamed("id", "k"), spark.range(2).withColumnRenamed("id", "k")
    assert not any(r.safe for r in snapshots.sync_plan(old, few, "k").collect())
    assert all(r.safe for r in snapshots.sync_plan(old, spark.range(12).withColumnRenamed("id", "k"), "k").collect())


def test_partition_overwrite_keeps_other_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    snapshots.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    snapshots.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, "p")
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "p").collect())) == [(1, "a"), (9, "b")]


def test_stream_sessions(spark, data):
    stream = jobs.read_events(spark, f"{data}/events.parquet").select("user_id", "at")
    closed = jobs.drain(jobs.sessions(stream, "user_id", "6 hours", "1 hour"), "test-sessions")
    assert 0 < closed.agg(F.sum("events")).first()[0] <= spark.read.parquet(f"{data}/events.parquet").count()
