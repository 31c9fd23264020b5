"""Operators on small tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import classify, extraction, graph, incremental, joins, listmatch, relational, resolution, results, screen, search


def one(spark, expression, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expression.alias("r")).first().r


def test_fold_and_matching_key(spark):
    assert one(spark, X.fold(F.col("a")), a=" ЁЛКА ") == "елка"
    assert one(spark, X.matching_key(F.col("a")), a="Иванов, Пётр-2") == "ивановпетр2"


def test_trigrams_are_padded_words(spark):
    assert sorted(one(spark, X.trigrams(F.col("a")), a="cat")) == ["  c", " ca", "at ", "cat"]
    assert one(spark, X.trigrams(F.col("a")), a="") == []


@pytest.mark.parametrize(("birth", "on", "age"), [("2000-02-29", "2023-02-28", 22), ("2000-02-29", "2023-03-01", 23), ("1990-05-05", "2020-05-05", 30)])
def test_age_at_date(spark, birth, on, age):
    d = datetime.date.fromisoformat
    assert one(spark, X.age_at(F.col("a"), F.col("b")), a=d(birth), b=d(on)) == age


@pytest.mark.parametrize(("a", "b", "same"), [("петров", "петрову", True), ("лев", "льва", True), ("ольга", "анна", False), ("смит", "смитт", True)])
def test_same_stem(spark, a, b, same):
    assert one(spark, X.same_stem(F.col("a"), F.col("b")), a=a, b=b) == same


def test_one_letter_apart(spark):
    assert one(spark, X.one_letter_apart(F.col("a"), F.col("b")), a="abc", b="abd")
    assert not one(spark, X.one_letter_apart(F.col("a"), F.col("b")), a="abc", b="abcd")


@pytest.mark.parametrize(
    ("a", "b", "match"),
    [("иван", "иван", "exact"), ("ивановна", "иванова", "typo"), ("и", "иван", "initial"), ("о", "иван", "mismatch"), ("иван", "иона", "mismatch"), ("", "иван", "missing")],
)
def test_compare_components(spark, a, b, match):
    assert one(spark, resolution.compare(F.col("a"), F.col("b")), a=a, b=b) == match


@pytest.mark.parametrize(
    ("surname", "given", "patronymic", "exact", "complete", "value"),
    [
        ("exact", "exact", "exact", True, True, 1.0),
        ("exact", "exact", "missing", False, True, 0.8),
        ("missing", "missing", "missing", True, True, 0.85),
        ("exact", "mismatch", "exact", False, True, 0.25),
        ("typo", "initial", "missing", False, False, 0.43),
    ],
)
def test_additive_score(spark, surname, given, patronymic, exact, complete, value):
    got = resolution.score(F.col("s"), F.col("g"), F.col("p"), F.col("e"), F.col("c"), F.lit(False))
    assert one(spark, got, s=surname, g=given, p=patronymic, e=exact, c=complete) == pytest.approx(value)


def test_decisions(spark):
    rows = [
        (1, 10, 0.95, False, True), (1, 11, 0.5, False, True),  # strong, far from the next
        (2, 10, 0.95, False, True), (2, 11, 0.90, False, True),  # two strong ones
        (3, 10, 0.25, True, True),  # in conflict
        (4, None, None, False, False),  # no candidate, no full name
        (5, 10, 0.6, False, True),  # medium
    ]
    df = spark.createDataFrame(rows, "k int, c int, v double, x boolean, f boolean")
    got = {r.k: (r.action, r.selected) for r in resolution.decide(df, "k", "c", "v", "x", "f").collect()}
    assert got == {1: ("AUTO_LINK", 10), 2: ("REVIEW", None), 3: ("CREATE_NEW", None), 4: ("REVIEW", None), 5: ("REVIEW", None)}


def test_list_match_statuses(spark):
    people = spark.createDataFrame([(1, ["иван", "петров"]), (2, ["анна", "белова"]), (3, ["ольга"]), (4, ["ивана", "сидоров"]), (5, ["глеб", "орлов"])], "person int, words array<string>")
    entries = spark.createDataFrame([(1, ["иван", "петров"]), (2, ["анна", "белова"]), (3, ["белова", "анна"]), (4, ["иван", "сидоров"])], "entry int, words array<string>")
    got = {r.person: r.status for r in listmatch.match_list(people, entries).collect()}
    assert got == {1: "MATCHED", 2: "AMBIGUOUS", 3: "INSUFFICIENT_DATA", 4: "NEEDS_REVIEW", 5: "NOT_MATCHED"}


@pytest.mark.parametrize(("birth", "other", "value"), [("1980-01-01", "1980-01-01", 1.0), ("1980-01-01", "1981-01-01", 0.5), (None, "1980-01-01", 1.0)])
def test_birth_dates_in_the_list_score(spark, birth, other, value):
    df = spark.createDataFrame([("k", "k", ["a", "b"], ["a", "b"], birth, other)], "k string, e string, w array<string>, x array<string>, b string, o string")
    assert df.select(listmatch.list_score(F.col("k"), F.col("e"), F.col("w"), F.col("x"), F.col("b"), F.col("o")).alias("r")).first().r == pytest.approx(value)


@pytest.mark.parametrize(
    ("kinds", "event", "status", "confidence"),
    [([], True, "NON_POLITICAL", 0.0), (["press"], True, "UNCERTAIN", 0.6), (["charge"], True, "POLITICAL", 0.7), (["press", "faith", "charge", "x"], True, "POLITICAL", 0.9), (["charge"], False, "UNCERTAIN", 0.5)],
)
def test_rule_classifier(spark, kinds, event, status, confidence):
    df = spark.createDataFrame([(kinds, event)], "k array<string>, e boolean")
    r = df.select(classify.status(F.col("k"), "charge", F.col("e")).alias("s"), classify.confidence(F.col("k"), "charge", F.col("e")).alias("c")).first()
    assert (r.s, r.c) == (status, pytest.approx(confidence))


def test_charge_counts_in_its_own_code(spark):
    check = classify.charge_listed(F.col("a"), ["282", "275"], ["20.3.3"], "коап")
    assert one(spark, check, a="УК ст. 282") and one(spark, check, a="УК ст. 222.1 ч. 4; УК ст. 275") and one(spark, check, a="КоАП ст. 20.3.3")
    assert not one(spark, check, a="КоАП ст. 282") and not one(spark, check, a="УК ст. 282.1") and not one(spark, check, a="")


def test_components_against_union_find(spark):
    import random

    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500), (600, 601), (600, 602)] + [(700, 700 + i) for i in range(1, 90)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 20, 25), (1, 8, 9), (2, 1, 2)], "k int, s int, e int")
    assert sorted(map(tuple, relational.merge_intervals(df, ["k"], "s", "e").collect())) == [(1, 0, 9, 3), (1, 20, 25, 1), (2, 1, 2, 1)]


def test_nearest_rank_equals_sorted_place(spark):
    import math

    values = [float(v % 37) for v in range(101)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    got = relational.nearest_rank(df, ["k"], "v", [50, 95, 99]).collect()
    assert [tuple(r) for r in got] == [("a", *(sorted(values)[math.ceil(p * 101 / 100) - 1] for p in (50, 95, 99)))]


def test_unique_match_and_priority(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, relational.unique_match_join(left, right, ["k"]).collect())) == [(1, "a"), (2, None), (3, None)]
    base = spark.createDataFrame([(1, "base"), (2, "base")], "k int, v string")
    strong, weak = spark.createDataFrame([(1, "mark")], "k int, v string"), spark.createDataFrame([(1, "title"), (2, None)], "k int, v string")
    assert sorted(map(tuple, relational.priority_overlay(base, "k", "v", [("mark", strong), ("title", weak)], "by").collect())) == [(1, "mark", "mark"), (2, "base", "base")]


def test_statistics_split_off_the_unknown_key(spark):
    df = spark.createDataFrame([("a", 12), ("a", 0), ("a", 30), ("", 5), (None, 7)], "k string, m int")
    known, unknown = relational.group_statistics(df, "k", "m")
    assert tuple(known.first()) == ("a", 3, 2, 1.8, 1.8, 2.5) and unknown.first().cases == 2


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (1, 6, "z")], "k int, s int, v string")
    got = sorted(map(tuple, joins.as_of_join(left, right, ["k"], "t", "s", ["v"]).collect()), key=str)
    assert got == [(1, 1, None), (1, 5, "y"), (2, 9, None)]


def test_typo_partners_equal_brute_force(spark):
    import random

    random.seed(1)
    words = list({"".join(random.choice("ab") for _ in range(random.randrange(1, 8))) for _ in range(60)})
    a, b = spark.createDataFrame([(w,) for w in words], "x string"), spark.createDataFrame([(w,) for w in words], "y string")
    got = {(r.x, r.y) for r in resolution.typo_partners(a, b, 1).collect()}
    every = a.crossJoin(b).filter(F.levenshtein("x", "y") <= 1)
    assert got == {(r.x, r.y) for r in every.collect()}


def test_trigram_pairs_equal_brute_force(spark):
    names = ["anna bell", "anna belle", "ana bell", "bob stone", "bob stones", "zed", "", "anna bell"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = {(r.x, r.y) for r in resolution.trigram_pairs(df, "k", "n", 0.5).collect()}
    both = df.crossJoin(df.select(F.col("k").alias("k2"), F.col("n").alias("n2"))).filter("k < k2")
    assert got == {(r.k, r.k2) for r in both.filter(X.jaccard(X.trigrams(F.col("n")), X.trigrams(F.col("n2"))) >= 0.5).collect()}


def test_spans_are_code_points_and_validated(spark):
    df = spark.createDataFrame([(1, "😀 Anna Bell met a@b.co"), (2, None)], "id int, text string")
    found = extraction.extract(df, "text", {"name": r"[A-Z][a-z]+ [A-Z][a-z]+", "email": r"\S+@\S+"})
    rows = [tuple(r) for r in extraction.mentions_table(found, "id", "text").orderBy("id", "start").collect()]
    assert rows == [(1, "succeeded", 0, "name", "Anna Bell", 2, 11), (1, "succeeded", 1, "email", "a@b.co", 16, 22), (2, "succeeded", None, None, None, None, None)]
    broken = spark.createDataFrame([(1, "abc", [("x", "zz", 0, 2)])], f"id int, text string, mentions {extraction.SPANS}")
    assert [r.status for r in extraction.mentions_table(broken, "id", "text").collect()] == ["failed"]


def test_sentences(spark):
    assert one(spark, extraction.sentences(F.col("a")), a="One two. Mr. J. Smith went! Really?  Yes") == ["One two.", "Mr.", "J. Smith went!", "Really?", "Yes"]


def test_span_scores(spark):
    p, g = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), spark.createDataFrame([(1, 2)], "a int, b int")
    r = extraction.score_spans(p, g, ["a", "b"]).first()
    assert (r.precision, r.recall) == (0.5, 1.0)


def test_findings_change(spark):
    stored = spark.createDataFrame([(1, True, 1, 1), (2, False, 1, 1), (3, True, 1, 1)], "person int, active boolean, first_seen_run int, last_seen_run int")
    found = spark.createDataFrame([(1,), (2,), (4,), (4,)], "person int")
    got = {r.person: (r.active, r.first_seen_run, r.last_seen_run, r.change) for r in results.upsert_findings(stored, found, 2).collect()}
    assert got == {1: (True, 1, 2, "kept"), 2: (True, 1, 2, "reactivated"), 3: (False, 1, 1, "deactivated"), 4: (True, 2, 2, "created")}


def test_absence_needs_a_match_record(spark):
    judged = spark.createDataFrame([(1, "POLITICAL", 0.8, 1, 1), (2, "POLITICAL", 0.9, 1, 2), (3, "POLITICAL", 0.9, 1, 3), (3, "UNCERTAIN", 0.6, 2, 4)], "person int, status string, confidence double, classified_at int, id int")
    active, matched = spark.createDataFrame([(1,), (2,), (3,)], "person int"), spark.createDataFrame([(1, "NOT_MATCHED"), (3, "NOT_MATCHED")], "person int, status string")
    assert [r.person for r in results.candidates(judged, active, matched).collect()] == [1]


def test_reports_fold_transitively(spark):
    rows = spark.createDataFrame([(1, "p", "a", None), (2, "p", "b", 12), (3, "p", "c", 12), (4, "q", "a", 12), (5, "p", "a", 7)], "id long, person string, reason string, term int")
    assert {r.id: r.case for r in results.fold_cases(rows).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 1}


def test_memo_and_pending(spark):
    answers = spark.createDataFrame([("k", "d1", False, 1), ("k", "d2", True, 2)], "key string, digest string, answer boolean, at int")
    asked = spark.createDataFrame([("k", "d1"), ("k", "d9"), ("z", "d1")], "key string, digest string")
    got = {(r.key, r.digest): (r.answer, r.told_by) for r in incremental.recall_answers(asked, answers, "key", "digest").collect()}
    assert got == {("k", "d1"): (False, "input"), ("k", "d9"): (True, "key"), ("z", "d1"): (None, "ask")}


def test_fusion_counts_each_list_once(spark):
    lists = spark.createDataFrame([("q", 1, 2.0), ("q", 1, 1.0), ("q", 2, 1.5), ("r", 2, 9.0)], "q string, d int, s double")
    got = {r.d: r.fused for r in search.reciprocal_rank_fusion(lists, "q", "d", "s").collect()}
    assert got == {1: pytest.approx(1 / 61), 2: pytest.approx(1 / 62 + 1 / 61)}


def test_screen(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").withColumn("y", (F.col("label") == 0).cast("int"))
    weights, bias = screen.train_logistic(vectors, "embedding", "y")
    scored = vectors.select("y", screen.linear_score(F.col("embedding"), F.array(*[F.lit(float(w)) for w in weights]), bias).alias("s"))
    means = {r.y: r.m for r in scored.groupBy("y").agg(F.avg("s").alias("m")).collect()}
    assert means[1] > means[0]


def test_name_readings_and_alignment(spark):
    df = spark.createDataFrame([("Иванов Иван Ильич", "Иван Ильич Иванов"), ("И. И. Иванов", "Иванов Иван Ильич"), ("Петров Иван", "Иванов Иван"), ("a b c d", "Иван Иванов")], "a string, b string")
    got = [(r.m_surname, r.m_given, r.m_patronymic) for r in resolution.best_alignment(df, "a", "b").collect()]
    assert got == [("exact", "exact", "exact"), ("exact", "initial", "initial"), ("mismatch", "exact", "missing"), ("missing", "missing", "missing")]


def test_unnamed_reports_join_the_one_case_they_point_at(spark):
    from factloom.operators import unnamed

    cases = spark.createDataFrame([(1, 1, "r", 12, "2024-05-01", 7), (2, 2, "r", 24, "2024-05-01", 7), (3, 3, "q", 12, "2024-05-01", 7), (4, 4, "q", 12, "2024-05-02", 7)], "id long, case long, region string, term int, on string, exact int")
    rows = spark.createDataFrame([(10, "r", 12, "2024-05-09", 7), (11, "q", 12, "2024-05-09", 7), (12, "q", 12, "2024-05-30", 7), (13, "r", 24, "2024", 7), (14, "", 24, "2024-05", 7), (15, "q", 12, "", 7)], "id long, region string, term int, on string, exact int")
    assert {r.id: r.case for r in unnamed.attach_unnamed(rows, cases).collect()} == {10: 1, 11: 11, 12: 11, 13: 2, 14: 14, 15: 15}


def test_age_is_carried_forward(spark):
    from factloom.operators import unnamed

    d = datetime.date
    told = spark.createDataFrame([(30, d(2020, 1, 1), d(2023, 6, 1))], "age int, told_on date, on date")
    r = unnamed.carried_age(told).first()
    assert (r.age_low, r.age_high) == (32, 34)
