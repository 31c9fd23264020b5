"""Candidates of names whose block holds most of the others, against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import resolution

PARTS = ("given", "surname", "patronymic")


def all_pairs(incoming, known, limit):
    """The same candidates with every pair formed."""
    both = incoming.crossJoin(known)
    key = lambda p: F.array_join(F.array_sort(F.array(*[F.col(f"{p}{c}") for c in PARTS])), " ")
    near = F.levenshtein("surname", "k_surname") <= X.typo_tolerance(F.greatest(F.length("surname"), F.length("k_surname")))
    by_name = F.coalesce(near & (F.left("given", F.lit(1)) == F.left("k_given", F.lit(1))), F.lit(False))
    met = both.withColumn("sources", F.concat_ws("+", F.when(key("") == key("k_"), "key"), F.when(by_name, "name"))).filter("sources <> ''")
    order = F.row_number().over(Window.partitionBy(*PARTS).orderBy(F.col("score").desc(), "person"))
    return resolution._compared(met).withColumn("r", order).filter(F.col("r") <= limit).drop("r")


def test_candidates_equal_all_pairs(spark):
    """Initials, parts of one letter, parts that aren't told, and typos of one and two letters, with fewer seats than fit."""
    rng = random.Random(7)
    long = ["abcdefghij", "abcdefghix", "abcdefgxyj", "abcdefgh", "abcde", "abcdx", "abcd", "abc", "b" * 30, "b" * 29 + "c"]
    pick = lambda: rng.choice([rng.choice(long), rng.choice("ab"), "ab", "abcde"])
    names = lambda n: list({(pick(), pick(), rng.choice([None, pick(), pick()])) for _ in range(n)})
    incoming = spark.createDataFrame(names(120), "given string, surname string, patronymic string")
    known = spark.createDataFrame([(f"p{i:03}", *n) for i, n in enumerate(names(200))], "person string, k_given string, k_surname string, k_patronymic string")
    columns = [*PARTS, "person", "sources", "m_surname", "m_given", "m_patronymic", "exact_form", "conflict", "score"]
    rows = lambda df: {tuple(r) for r in df.select(*columns).collect()}
    for limit in (3, 30):
        want = rows(all_pairs(incoming, known, limit))
        assert rows(resolution.candidates(incoming, known, limit)) == want
        assert rows(resolution.candidates(incoming, known, limit, plausible=True)) == {r for r in want if not r[9] and r[10] >= resolution.REVIEW}


def test_a_block_is_not_paired_out(spark):
    """3,000 incoming and 3,000 known names of one surname and initial: nine million pairs, of which 30 a name are looked at."""
    base = spark.range(3000).select(F.lit("smith").alias("surname"), F.concat(F.lit("a"), F.sha1(F.col("id").cast("string"))).alias("given"))
    incoming = base.withColumn("patronymic", F.lit("one"))
    known = base.select(F.concat("given", F.lit("!")).alias("person"), F.reverse("given").alias("k_patronymic"), F.col("surname").alias("k_surname"), F.concat("given", F.lit("xxxxxxx")).alias("k_given"))
    found = resolution.candidates(incoming, known)
    least = [r.person for r in known.select("person").orderBy("person").limit(30).collect()]
    assert found.count() == 90_000 and sorted({r.person for r in found.select("person").distinct().collect()}) == least


def test_all_pairs_of_a_dispute(spark):
    """Every two third parts of a name are a pair, not each with the first alone."""
    df = spark.createDataFrame([("a", "b", t) for t in ("xxx", "yyy", "yyz", "zzz")] + [("c", "d", "e")], "given string, surname string, patronymic string")
    found = {(r.patronymic, r.other): r.kind for r in resolution.all_dispute_pairs(df).collect()}
    assert len(found) == 6 and [k for k, v in found.items() if v == "similar"] == [("yyy", "yyz")]
