"""Grouping, merging and batch resolution on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import identity

MENTION = "mention long, article long, first string, last string, patronymic string, region string"


def test_bases(spark):
    got = {r.w: set(r.b) for r in spark.createDataFrame([("моора",), ("ли",), ("невзоровых",), ("заболотнего",), ("дудь",)], "w string").select("w", identity.bases(F.col("w")).alias("b")).collect()}
    assert got["моора"] == {"моора", "моор"} and got["ли"] == {"ли"} and got["дудь"] == {"дудь", "дуд"}
    assert "невзоров" in got["невзоровых"] and "заболотнь" in got["заболотнего"]


def test_surname_roots(spark):
    rows = [("александр", "моор"), ("александр", "моора"), ("александр", "моору"), ("борис", "моора"), ("борис", "дудем"), ("борис", "дудь")]
    got = {(r.first, r.last): r.root for r in identity.surname_roots(spark.createDataFrame(rows, "first string, last string"), "first", "last").collect()}
    assert got == {("александр", "моор"): "моор", ("александр", "моора"): "моор", ("александр", "моору"): "моор", ("борис", "моора"): "моор", ("борис", "дудем"): "дуд", ("борис", "дудь"): "дуд"}


def test_group_mentions(spark):
    rows = [
        (1, 1, "Иван", "Петров", "Ильич", "Крым"), (2, 1, "Ивана", None, None, None), (3, 2, "Иван", "Петрову", "Ильича", None), (4, 2, "Иван", "Петров", None, None),
        (5, 2, None, "Петрова", None, None), (6, 3, "Иван", "Петров", None, None), (7, 4, None, "Петров", None, None), (8, 3, "И.", "Петрову", None, None), (9, 3, "О.", "Петрову", None, None),
        (10, 5, "Анна", "Белова", None, None), (11, 5, "Олег", "Белов", None, None), (12, 5, None, "Беловой", None, None), (13, 6, "Горинов", "Горинов", None, None),
    ]
    got = {r.mention: r.key for r in identity.group_mentions(spark.createDataFrame(rows, MENTION)).collect()}
    assert got[1] == got[3] == got[4] == got[5] and " · крым" in got[1]  # the one card of the name, then the one person of the article
    assert got[6] == "иван петров" == got[8] and got[9] is None and got[7] is None and got[2] is None
    assert got[10] == "анна белов" and got[11] == "олег белов" and got[12] is None  # two of that surname in the article
    assert got[13] is None


def test_merges_follow_chains(spark):
    persons = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, None)], "person long, merged_into long")
    facts = spark.createDataFrame([(1, "a"), (3, "a"), (2, "b"), (4, "a"), (9, "z")], "person long, alias string")
    got = identity.merge_people(persons, {"aliases": facts})["aliases"]
    assert sorted((r.person, r.alias) for r in got.collect()) == [(3, "a"), (3, "b"), (4, "a"), (9, "z")]


def test_batch_resolution_is_independent_of_partitions(spark):
    rows = [(i, f"k{i % 3}", i % 5 != 0, 100 - i) for i in range(1, 31)]
    linked = spark.createDataFrame([(1, 900)], "mention long, person long")
    runs = [sorted(map(tuple, identity.resolve_batch(spark.createDataFrame(rows, "mention long, key string, full boolean, at int").repartition(n), linked, ["at"]).collect()), key=str) for n in (1, 7)]
    assert runs[0] == runs[1]
    by = {r[0]: r for r in runs[0]}
    assert by[1][1:] == (900, False, "linked") and by[5][3] == "review" and sum(r[3] == "created" for r in runs[0]) == 3
    assert by[29][3] == "created"  # the least `at` of its key


def test_decided_and_clear_pairs(spark):
    entities = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5), ("d", 2)], "key string, mentions int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert {r.key: r.into for r in identity.merge_decided(entities, pairs).collect()} == {"a": "b", "b": "b", "c": "b"}
    assert [tuple(r) for r in identity.clear_pairs(pairs.unionAll(spark.createDataFrame([("x", "y")], "a string, b string"))).collect()] == [("x", "y")]


def test_officials(spark):
    rows = [("a", "судья "), ("a", "x"), ("a", "y"), ("b", "бывший судья "), ("c", "судья "), ("c", "судья "), ("c", "x"), ("c", "x"), ("c", "x"), ("d", "судья ")]
    got = {r.key for r in identity.officials(spark.createDataFrame(rows, "key string, before string"), "судья", "бывш").collect()}
    assert got == {"c", "d"}
