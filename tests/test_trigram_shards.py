"""Trigram candidates by batches and shards: against brute force, for long forms too, and without rows of pairs."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from growth import most_joined
from test_similarity import brute, grams, jaccard, word_similarity

from factloom.operators import similarity, trigrams


def test_shards_and_batches_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SHARD", 25)
    monkeypatch.setattr(similarity, "BATCH", 20)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("абв") for _ in range(rng.choice([1, 2, 3, 4, 6, 9])))
    name = lambda n: " ".join(word() for _ in range(n))
    forms = [(f"p{i % 45}", name(rng.choice([1, 2, 3, 3, 25]))) for i in range(70)]
    names = list({name(rng.choice([1, 2, 3])) for _ in range(30)})
    found = similarity.trigram_candidates(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(forms, "person string, form string"), 4)
    assert {(r.name, r.person, r.similarity) for r in found.collect()} == brute(names, forms, 4)


@pytest.mark.parametrize("merged", [False, True])
def test_like_words_do_not_become_rows_of_pairs(spark, monkeypatch, merged):
    write, most = similarity.materialize, []

    def watched(df, name):
        most.append(most_joined(df))
        return write(df, name)

    monkeypatch.setattr(similarity, "materialize", watched)
    # each asked word is similar to the words of all forms, but less than by three quarters
    names = spark.range(300).selectExpr("concat('abcdef', chr(1072 + id div 30), chr(1072 + id % 30), 'xy') as name")
    forms = spark.range(300).selectExpr("concat('p', lpad(id, 3, '0')) as person", "concat('abcdef', chr(1072 + id div 30), 'qr', chr(1072 + id % 30)) as form")
    found = similarity.merged_candidates(names, forms.selectExpr("*", "false as alias"), 3) if merged else similarity.trigram_candidates(names, forms, 3)
    rows = found.collect()
    assert len(rows) == 900
    assert max(*most, most_joined(found)) < 45_000


def test_pairs_of_a_group(monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([2, 3, 5, 8])))
    texts, asked = list({" ".join(word() for _ in range(rng.choice([1, 2, 3, 20]))) for _ in range(60)}), list({word() for _ in range(40)})
    forms = pa.table({"form": texts, "ordered": ["".join(grams(t)) for t in texts]})
    least = [rng.choice([0.5, 0.6, 0.75, 1.0]) for _ in asked]
    units = pa.table({"unit": asked, "t": ["".join(dict.fromkeys(grams(w))) for w in asked], "least": least})
    for pairs in (16_384, 3):
        monkeypatch.setattr(trigrams, "PAIRS", pairs)
        for whole, value in ((False, word_similarity), (True, lambda w, t: jaccard(grams(w), grams(t)))):
            of, at, found = trigrams._pairs(units, forms, whole)
            expected = {(i, j): float(v) for i, w in enumerate(asked) for j, t in enumerate(texts) if (v := value(w, t)) >= least[i]}
            assert dict(zip(zip(of.tolist(), at.tolist(), strict=True), found.tolist(), strict=True)) == expected
