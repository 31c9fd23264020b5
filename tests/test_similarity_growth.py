"""Trigram candidates of a word that very many persons have: each of them is weighed once for the word, not for each name."""

from __future__ import annotations

from growth import most_joined

from factloom.operators import similarity


def test_a_common_word_does_not_multiply_names_and_persons(spark, monkeypatch):
    write, most = similarity.materialize, []

    def watched(df, name):
        most.append(most_joined(df))
        return write(df, name)

    monkeypatch.setattr(similarity, "materialize", watched)
    names = spark.range(300).selectExpr("concat('common zq', id) as name")
    forms = spark.range(300).selectExpr("concat('p', lpad(id, 3, '0')) as person", "concat('common yw', id) as form")
    found = similarity.trigram_candidates(names, forms, 3)
    assert max(*most, most_joined(found)) < 45_000
    rows = {(r.name, r.person, r.similarity) for r in found.collect()}
    assert rows == {(f"common zq{i}", f"p{p:03}", 1.0) for i in range(300) for p in range(3)}
