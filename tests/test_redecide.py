"""Decisions that need more than a name, and their renewal by new evidence."""

from __future__ import annotations

import random

from factloom.operators import resolution


def test_redecided_reviews_equal_a_full_decision(spark):
    rng = random.Random(4)
    rows = [(k, c if c else None, rng.choice([0.2, 0.5, 0.84, 0.9, 0.9, 0.97]) if c else None, rng.random() < 0.1, k % 9 != 0, rng.random() < 0.2) for k in range(300) for c in ([0] if k % 11 == 0 else range(1, rng.randrange(2, 4)))]
    columns = "k int, candidate int, v double, conflict boolean, full boolean, proven boolean"
    told = [(r[0], r[1]) for r in rows if r[1] and rng.random() < 0.3] * 2
    decided = lambda rs: resolution.decide(spark.createDataFrame(rs, columns), "k", "candidate", "v", "conflict", "full", "proven")
    first, new = decided(rows), decided([(*r[:5], r[5] or (r[0], r[1]) in told) for r in rows])
    fields = ["action", "selected", "margin", "plausible", "reasons", "best"]
    before, after = ({r.k: tuple(r[c] for c in fields) for r in df.collect()} for df in (first, new))
    again = {r.k: tuple(r[c] for c in fields) for r in resolution.redecide(first, spark.createDataFrame(told, "k int, candidate int"), "k").collect()}
    assert again and {k: v for k, v in after.items() if before[k] != v} == again
    assert any(v[0] == "AUTO_LINK" for v in again.values()) and any(v[0] == "REVIEW" for v in again.values())


def test_a_strong_name_alone_waits(spark):
    rows = [(1, 10, 0.95, False, True, False), (2, 10, 0.95, False, True, True), (3, None, None, False, True, False)]
    df = spark.createDataFrame(rows, "k int, c int, v double, x boolean, f boolean, p boolean")
    got = {r.k: (r.action, r.selected, r.reasons) for r in resolution.decide(df, "k", "c", "v", "x", "f", "p").collect()}
    assert got == {1: ("REVIEW", None, resolution.NAME_ONLY), 2: ("AUTO_LINK", 10, ""), 3: ("CREATE_NEW", None, "no plausible candidate")}
