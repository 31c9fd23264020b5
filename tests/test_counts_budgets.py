"""Counts of records by age over a histogram, and what a model is asked within its budget."""

from __future__ import annotations

import datetime
import hashlib
import random

import pytest

from factloom.operators.casework import records_of_age
from factloom.operators.memo import within_budget

D = datetime.date


def test_ages_against_brute_force(spark):
    """Leap days on both sides, records without a birth day, unknown sexes, days outside of the base's."""
    rng = random.Random(3)
    day = lambda: rng.choice([D(1980, 2, 29), D(1984, 2, 29), D(1981, 2, 28), D(1981, 3, 1), D(1960 + rng.randrange(50), 1 + rng.randrange(12), 1 + rng.randrange(28))])
    base = [(day() if rng.random() < 0.9 else None, rng.choice(["f", "m", None])) for _ in range(2000)]
    on = lambda: rng.choice([D(2020, 2, 29), D(2021, 2, 28), D(2021, 3, 1), D(2019, 2, 28), D(2024, 6, 5)])
    asked = [(i, rng.choice([None, 5, 20, 37, 40, 41, 60, 90]), on() if rng.random() < 0.9 else None, rng.choice(["f", "m", None])) for i in range(200)]
    found = records_of_age(spark.createDataFrame(asked, "id long, age int, `on` date, gender string"), spark.createDataFrame(base, "birth date, b_gender string")).collect()
    age = lambda b, d: d.year - b.year - ((d.month, d.day) < (b.month, b.day))
    for i, a, d, g in asked:
        want = None if a is None or d is None else sum(b is not None and a <= age(b, d) <= a + 1 and (g is None or s is None or g == s) for b, s in base)
        assert next(r.records for r in found if r.id == i) == want, (a, d, g)
    assert len(found) == len(asked)
    empty = records_of_age(spark.createDataFrame(asked[:5], "id long, age int, `on` date, gender string"), spark.createDataFrame([], "birth date, b_gender string"))
    assert {r.records for r in empty.collect()} <= {0, None}


ASKED = "model string, input string, priority int, cost long"


@pytest.mark.parametrize("seed", [1, 2])
def test_budgets_against_brute_force(spark, seed):
    """Nine in ten inputs are of one model and one priority; repeats, null costs, costs of nothing, answers that are kept."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("ab"), f"i{rng.randrange(700)}", 5 if rng.random() < 0.9 else rng.randrange(9), rng.choice([None, 0, 1, 7, 50])) for _ in range(1500)]
    memo = [("hot", f"i{i}") for i in range(0, 700, 9)] * 2
    budgets = {"hot": 1234, "a": 0, "c": 10}
    found = within_budget(spark.createDataFrame(rows, ASKED), spark.createDataFrame(memo, "model string, input string"), spark.createDataFrame(list(budgets.items()), "model string, budget long")).collect()
    one = {}
    for m, i, p, c in rows:
        old = one.get((m, i), (p, 0))
        one[m, i] = (max(old[0], p), max(old[1], c or 0))
    want = set()
    for m, budget in budgets.items():
        spent = 0
        pending = sorted(((-p, hashlib.md5(f"{m}:{i}".encode()).hexdigest(), i, c) for (k, i), (p, c) in one.items() if k == m and (k, i) not in memo))
        for p, _, i, c in pending:
            spent += c
            if spent > budget:
                break
            want.add((m, i, -p, c, spent))
    assert {(r.model, r.input, r.priority, r.cost, r.spent) for r in found} == want
    assert all(sum(r.cost for r in found if r.model == m) <= b for m, b in budgets.items())
    none = within_budget(spark.createDataFrame([], ASKED), spark.createDataFrame(memo, "model string, input string"), spark.createDataFrame([("hot", 5)], "model string, budget long"))
    assert none.count() == 0
