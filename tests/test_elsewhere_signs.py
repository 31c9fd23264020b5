"""Persons named elsewhere, sign by sign: against a plain reading, in stretches, and without pairs of all mentions."""

from __future__ import annotations

import datetime
import random

import pyarrow as pa
from growth import most_joined

from factloom.operators import casework, elsewhere

DAY, AGE = datetime.date(2024, 3, 5), r"([0-9]+) years"
ASKED = "id long, article long, on date, places array<string>, stage string, age int, gender string, initial string, charges array<string>"
NAMED = "person long, name string, n_article long, n_on date, n_places array<string>, n_stage string, n_gender string, near string, n_charges array<string>, n_start long"
NONE = "id long, person long, decision string"


def _later(days):
    return DAY + datetime.timedelta(days)


def _plainly(asked, named, decisions, days, shown):
    """The rows of named_elsewhere from all pairs."""
    out, decided = set(), {(i, p): d for i, p, d in decisions}
    for id_, article, on, places, stage, age, gender, initial, charges in asked:
        persons, begin = {}, (initial or "").replace(".", "").strip().lower()
        for person, name, n_article, n_on, n_places, n_stage, n_gender, near, n_charges, n_start in named:
            if on is None or article == n_article or abs((on - n_on).days) > days or not set(places) & set(n_places):
                continue
            if (stage is not None and stage != n_stage) or (gender and n_gender and gender != n_gender):
                continue
            by_age, by_charge = age is not None and f"{age} years" in near.split("; "), bool(set(charges or []) & set(n_charges or []))
            by_initial = begin != "" and any(w.startswith(begin) for w in name.lower().split())
            if by_age or by_charge or by_initial:
                strength = 2 * by_age + by_charge
                persons.setdefault(person, []).append((-strength, n_on, n_article, n_start, name, by_age, by_charge, by_initial))
        best = []
        for person, rows in persons.items():
            weak, _, n_article, _, name, *signs = min(rows)
            best.append(({"same": 0, "different": 2}.get(decided.get((id_, person)), 1), weak, name, person, n_article, *signs))
        out |= {(id_, rank, row[3], *row[4:]) for rank, row in enumerate(sorted(best)[:shown], 1)}
    return out


def test_like_all_pairs(spark):
    r = random.Random(7)
    some = lambda *xs: r.choice(xs)
    lists = lambda xs: r.sample(xs, r.choice((1, 1, 1, 2)))
    asked = [(i, some(1000 + i, r.randrange(200)), some(_later(r.randrange(25)), _later(r.randrange(25)), None) if i % 20 == 0 else _later(r.randrange(25)), lists(["omsk", "tver"]), some(None, "trial", "search"),
              some(None, 30, 31), some(None, "", "f", "m"), some("", None, "B.", "ca"), some(None, [], ["205"], ["205"], ["207"], ["205", "207"])) for i in range(120)]
    named = []
    for i in range(400):
        person = r.randrange(90)
        named.append((person, f"{some('Abe', 'Bob', 'Cat')} {person % 11}", i, _later(r.randrange(25)), lists(["omsk", "tver", "perm"]), some(None, "trial", "search"), some(None, "f", "m", ""), "; ".join(f"{a} years" for a in lists([29, 30, 31])),
                      some(None, ["205"], ["207", "205"], ["9"], []), 0))
    decisions = [(i, r.randrange(90), some("same", "different")) for i in range(0, 120, 9)]
    tables = spark.createDataFrame(asked, ASKED), spark.createDataFrame(named, NAMED), spark.createDataFrame(decisions, NONE)
    found = casework.named_elsewhere(*tables, 4, 3, AGE).select("id", "rank", "person", "article", "age_match", "article_match", "by_initial")
    rows = found.collect()
    assert {tuple(row) for row in rows} == _plainly(asked, named, decisions, 4, 3)
    assert len(rows) == len(set(rows))


def test_persons_with_two_names_are_found_without_all_pairs(spark, monkeypatch):
    write, most = casework.materialize, []

    def watched(df, name):
        most.append(most_joined(df))
        return write(df, name)

    monkeypatch.setattr(casework, "materialize", watched)
    asked = [(i, 10_000 + i, DAY, ["omsk"], None, None, None, "", ["205"]) for i in range(300)]
    # each person is listed first by a name of a later publication, and shown by that of the earlier one
    named = [(p, f"a{p:03}", 100 + p, _later(3), ["omsk"], "trial", None, "", ["205"], 0) for p in range(150)] + [(p, f"z{p:03}", 300 + p, DAY, ["omsk"], "trial", None, "", ["205"], 0) for p in range(150)]
    found = casework.named_elsewhere(spark.createDataFrame(asked, ASKED), spark.createDataFrame(named, NAMED), spark.createDataFrame([], NONE), 5, 2, AGE)
    assert {(r.id, r["rank"], r.person, r.article) for r in found.collect()} == {(i, p + 1, p, 300 + p) for i in range(300) for p in range(2)}
    assert max(*most, most_joined(found)) < 30_000


def test_stretches_give_the_same(monkeypatch):
    r = random.Random(3)
    asked = pa.table({
        "article": list(range(50)), "day": [r.randrange(30) for _ in range(50)], "stage": [r.choice((None, "trial")) for _ in range(50)], "sex": [r.choice((None, "f", "m")) for _ in range(50)],
        "charge": [r.choice((None, "1", "2")) for _ in range(50)], "value": [r.choice(("30", "31")) for _ in range(50)],
        "found": pa.array([[]] * 50, pa.list_(pa.struct({"person": pa.int64(), "name": pa.string(), "n_article": pa.int64(), "strength": pa.int32()}))),
    })
    person = [r.randrange(60) for _ in range(300)]
    told = pa.table({
        "person": person, "name": [f"{r.choice('ab')}{p}" for p in person], "n_article": list(range(300)), "n_on": [r.randrange(30) for _ in person], "n_start": [0] * 300, "day": [r.randrange(30) for _ in person],
        "stage": [r.choice((None, "trial")) for _ in person], "sex": [r.choice((None, "f", "m")) for _ in person], "value": [r.choice(("30", "31", "32")) for _ in person], "charges": [r.choice(([], ["1"], ["2", "1"])) for _ in person],
    })
    at_once = elsewhere.fill(asked, told, 5, 4, 2).to_pylist()
    monkeypatch.setattr(elsewhere, "STRETCH", 2)
    monkeypatch.setattr(elsewhere, "CELLS", 30)
    monkeypatch.setattr(elsewhere, "SMALL", 0)
    assert elsewhere.fill(asked, told, 5, 4, 2).to_pylist() == at_once
    assert sum(len(row["found"]) for row in at_once) > 100
