"""Spans that are scored: no task groups all those of its texts."""

from __future__ import annotations

from factloom.operators import extraction


def _prepared(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_dealt_out_before_they_are_grouped(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, start long, end long")
    found = extraction.score_spans(rows((1, 0, 2), (1, 0, 2), (1, 3, 4), (None, 0, 1)), rows((1, 0, 2), (2, 0, 2), (None, 0, 1)), ["id", "start", "end"])
    below = _prepared(found).partition("REPARTITION_BY_COL")[2]
    assert below and "Aggregate" not in below.partition("== Initial Plan ==")[0]
    assert tuple(found.first()) == (1, 1 / 3, 1 / 3, 1 / 3)
