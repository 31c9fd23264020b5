"""Fuzzy candidates against brute force over trigrams."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factloom.operators import resolution, similarity


def grams(text):
    return [f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)]


def jaccard(a, b):
    a, b = set(a), set(b)
    return Fraction(len(a & b), len(a | b)) if a and b else Fraction(0)


def word_similarity(word, name):
    t, o = grams(word), grams(name)
    return max((jaccard(t, o[i:j]) for i in range(len(o)) for j in range(i + 1, len(o) + 1)), default=Fraction(0))


def brute(names, forms, limit):
    out = set()
    for name in names:
        best = {}
        for person, form in forms:
            words = [w for w in name.split() if len(w) >= 3]
            scores = [jaccard(grams(name), grams(form)), *[word_similarity(w, form) for w in words]]
            if scores[0] >= Fraction(3, 10) or any(s >= Fraction(1, 2) for s in scores[1:]):
                best[person] = max(best.get(person, 0), *scores)
        ranked = sorted(((round(float(v), 4), p) for p, v in best.items()), key=lambda x: (-x[0], x[1]))
        out |= {(name, p, v) for v, p in ranked[:limit]}
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 1000), (2, 3)])
def test_candidates_against_brute_force(spark, seed, limit):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("абвг") for _ in range(rng.choice([1, 2, 3, 4, 6, 8])))
    name = lambda: " ".join(word() for _ in range(rng.choice([1, 2, 3])))
    forms = [(f"p{i}", name()) for i in range(40)] + [(f"p{i}", name()) for i in range(20)] + [("p1", "")]
    names = list({name() for _ in range(40)}) + ["", "!"]
    found = similarity.trigram_candidates(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(forms, "person string, form string"), limit)
    assert {(r.name, r.person, r.similarity) for r in found.collect()} == brute([n for n in names if n not in ("", "!")], [f for f in forms if f[1]], limit)


def test_typos_that_blocks_miss_are_found(spark):
    """A typo in the given name's first letter, a surname three edits off, and an alias."""
    forms = [("1", "кузнецов иван", False), ("2", "александровский пётр", False), ("3", "белова анна", False), ("3", "чернова анна", True), ("4", "совсем другой", False)]
    df = spark.createDataFrame(forms, "person string, form string, alias boolean")
    asked = spark.createDataFrame([("кузнецов жван",), ("олександревскай пётр",), ("анна чернова",), ("ыыы",)], "name string")
    got = {(r.name, r.person): (r.sources, r.similarity) for r in similarity.merged_candidates(asked, df).collect()}
    assert ("кузнецов жван", "1") in got and ("олександревскай пётр", "2") in got and got["анна чернова", "3"] == ("alias+trigram", 1.0)
    assert not any(name == "ыыы" or person == "4" for name, person in got)


def test_a_trigram_of_nearly_all_names_is_not_looked_up(spark):
    """Nine names in ten begin alike: the asked name's rare trigrams bring its one candidate."""
    forms = spark.createDataFrame([(str(i), f"иван{i:05}") for i in range(3000)] + [("x", "щукарь")], "person string, form string")
    found = similarity.trigram_candidates(spark.createDataFrame([("щукарев",)], "name string"), forms).collect()
    assert [r.person for r in found] == ["x"]


def test_word_similarity_of_columns(spark):
    pairs = [("слово", "два слова"), ("два", "двадцать"), ("ааа", "ааааа"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    value = similarity.word_similarity(F.array_distinct(similarity.ordered_trigrams(F.col("a"))), similarity.ordered_trigrams(F.col("b")))
    assert [r.v for r in df.select(value.alias("v")).collect()] == pytest.approx([float(word_similarity(a, b)) for a, b in pairs])


def test_dispute_pairs_of_a_name_of_many(spark):
    """A name of n third parts has n - 1 pairs, besides those of a spelling."""
    thirds = [f"p{i:04}xyz" * 2 for i in range(500)] + ["q", "qa", "qab"]
    df = spark.createDataFrame([("a", "b", t) for t in thirds] + [("c", "d", "e")], "given string, surname string, patronymic string")
    found = [(r.patronymic, r.other, r.kind) for r in resolution.dispute_pairs(df).collect()]
    assert sorted(f for f in found if f[2] == "similar") == [("q", "qa", "similar"), ("qa", "qab", "similar")]
    assert sorted(f[1] for f in found if f[2] == "patronymic") == sorted(thirds)[1:]
