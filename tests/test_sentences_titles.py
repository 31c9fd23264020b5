"""Sentences keep their digits, and titles the references that are no basic ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import extraction
from factloom.sources import html


def test_a_sentence_is_trimmed_of_blanks_alone(spark):
    """The second sentence (place 1) begins and ends with its place's digit, and one has blanks around it."""
    df = spark.createDataFrame([("  First one. 1 is next to 1. Third 2",)], "text string")
    assert df.select(extraction.sentences(F.col("text"))).first()[0] == ["First one.", "1 is next to 1.", "Third 2"]


def test_a_title_as_written(spark):
    pages = [("<title> a &lt;b&gt; &amp; c &quot;d&amp </title><title>x</title>",), ("<p>none",), ("<title>&amp;lt;</title>",)]
    df = spark.createDataFrame(pages, "html string")
    assert [r[0] for r in df.select(html.title_of(F.col("html"))).collect()] == ['a <b> & c &quot;d&amp', "", "&lt;"]
