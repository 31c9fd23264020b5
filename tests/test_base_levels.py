"""Names against a base: counted by sets of words, never by pairs of a name and a record."""

from __future__ import annotations

import random

from growth import most_joined

from factloom.operators import review


def _level(words, base):
    mine = set(words)
    fits = [set(w) for w in base if len(set(w)) >= 2 and (set(w) <= mine or mine <= set(w))]
    exact = sum(w == mine for w in fits)
    level = "in_base" if exact == 1 and (len(mine) >= 3 or len(fits) == 1) else "probably" if len(fits) == 1 else "namesakes"
    return (level, 1 if level == "in_base" else len(fits)) if fits and len(mine) >= 2 else None


def test_levels_of_names_of_any_length(spark):
    rng = random.Random(7)
    name = lambda: [rng.choice("abcdefghijkl") for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 9, 12, 20]))]
    asked, base = [name() for _ in range(150)], [name() for _ in range(150)]
    both = [spark.createDataFrame(list(enumerate(rows)), f"{c} long, words array<string>") for c, rows in (("person", asked), ("record", base))]
    found = {r["person"]: (r["level"], r["records"]) for r in review.base_levels(*both).collect()}
    assert found == {i: level for i, w in enumerate(asked) if (level := _level(w, base))}


def test_a_common_name_brings_no_pairs_together(spark, monkeypatch):
    monkeypatch.setattr(review, "materialize", lambda df, name: df)
    same = spark.range(600).selectExpr("id as person", "array('ann', 'lee') as words")
    found = review.base_levels(same, same.withColumnRenamed("person", "record"))
    assert most_joined(found) <= 1200
    assert {(r["level"], r["records"]) for r in found.collect()} == {("namesakes", 600)}
