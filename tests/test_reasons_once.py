"""Reasons of mentions: the texts are matched once, whatever is asked of their mentions."""

from __future__ import annotations

from factloom.operators import context


def test_texts_are_matched_once(spark):
    docs = spark.createDataFrame([(1, "the anna came. the annas left"), (2, None), (3, "old bert")], "id long, text string")
    given = spark.createDataFrame([("anna",)], "word string")
    found = context.mention_reasons(docs, "id", "text", "(?:the|old) [a-z]+", ("the",), given, ("s",))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.place, r.reason) for r in found.collect()} == {(1, 0, "kept"), (1, 1, "kinship"), (3, 0, "kept")}
