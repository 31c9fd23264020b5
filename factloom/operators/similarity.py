"""Fuzzy candidates for names: trigram similarity of whole names, and word similarity of their words, over names and aliases.

A word's similarity to a name is the best that any continuous extent of the name's ordered trigrams reaches: trigrams in
common over trigrams of either. A word is first held against the words of the names: what its best words reach with as many
persons as are shown is the least that a name must reach for it, so what is found doesn't grow with the number of names.
Words keep their best persons each, before any name meets them, and a name that has enough of these asks for whole names
that are better only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text as X
from factloom.operators.trigrams import meeting, reaching
from factloom.storage import materialize

#: Least similarity of names, least word similarity of a word, letters of a word that is asked for.
NAME_LEAST, WORD_LEAST, WORD_LETTERS = 0.3, 0.5, 3
#: Places are rounded to so much.
ROUNDED = 0.00005
#: What is asked at once and forms of a shard, at most; batches of few.
BATCH, SHARD, BATCHES = 20_000, 100_000, 16


def ordered_trigrams(c: Column) -> Column:
    """The trigrams of a text's words in order, each word padded by two blanks before and one after; repeats stay."""
    padded = F.transform(X.words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))


@F.pandas_udf(T.DoubleType())
def _word_similarity(asked: pd.Series, ordered: pd.Series) -> pd.Series:
    """The best Jaccard similarity of one of the sets `asked` with an extent of `ordered`; both are trigrams one behind the other.

    The best extents begin and end with a common trigram, so each is read once from each of these on.
    """
    cut = lambda joined: [joined[i : i + 3] for i in range(0, len(joined), 3)]

    def best(sets: Sequence[str], joined: str) -> float:
        grams, out = cut(joined), 0.0
        for one in sets:
            mine = set(cut(one))
            hits = [i for i, g in enumerate(grams) if g in mine]
            for i in hits:
                common, more = set(), set()
                for g in grams[i : hits[-1] + 1]:
                    if g in mine:
                        common.add(g)
                        out = max(out, len(common) / (len(mine) + len(more)))
                    else:
                        more.add(g)
        return out

    return pd.Series([best(a, o) for a, o in zip(asked, ordered, strict=True)], dtype="float64")


#: Not to be moved into the condition of a join, which can't call it.
_word_similarity = _word_similarity.asNondeterministic()


def word_similarity(asked: Column, ordered: Column) -> Column:
    """The best Jaccard similarity of the set `asked` with an extent of `ordered`; extents begin and end with a common trigram."""
    hits = F.filter(F.sequence(F.lit(1), F.size(ordered) + 1), lambda i: F.coalesce(F.array_contains(asked, F.get(ordered, i - 1)), F.lit(False)))
    value = lambda i, j: X.jaccard(asked, F.slice(ordered, i, j - i + 1))
    return F.coalesce(F.array_max(F.transform(hits, lambda i: F.array_max(F.transform(F.filter(hits, lambda j: j >= i), lambda j: value(i, j))))), F.lit(0.0))


def _units(names: DataFrame) -> DataFrame:
    """(name, unit, whole): what is asked for of each distinct name: itself, and its words of three letters or more."""
    words = F.filter(F.array_distinct(X.words(F.col("name"))), lambda w: F.length(w) >= WORD_LETTERS)
    each = F.concat(F.array(F.struct(F.col("name").alias("unit"), F.lit(True).alias("whole"))), F.transform(words, lambda w: F.struct(w.alias("unit"), F.lit(False).alias("whole"))))
    return names.select("name").distinct().withColumn("u", F.explode(each)).select("name", "u.unit", "u.whole")


def _best(found: DataFrame, key: str, limit: int) -> DataFrame:
    """found (key, person, similarity) cut to the best `limit` persons of each key."""
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), "person"))
    return found.groupBy(key, "person").agg(F.max("similarity").alias("similarity")).withColumn("_r", order).filter(F.col("_r") <= limit).drop("_r")


def _meet(asked: DataFrame, forms: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function (of operators.trigrams) over batches of asked (unit, t, least) and shards of forms (form, ordered, ...).

    Both are written tables. A batch meets every shard once, so what is sent grows with batches x shards, not with pairs.
    """
    n, m = asked.count(), forms.count()
    batches, shards = max(-(-n // BATCH), min(BATCHES, -(-n // 64)), 1), max(-(-m // SHARD), 1)
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = asked.withColumn("_b", deal("unit", batches)).withColumn("_s", every(shards))
    b = forms.withColumn("_s", deal("form", shards)).withColumn("_b", every(batches))
    # few groups of much work: adaptive execution must not put them into one task
    tasks = min(4 * batches * shards, 400)
    sides = [df.withColumn("group", F.col("_b") * shards + F.col("_s")).drop("_b", "_s").repartition(tasks, "group").groupBy("group") for df in (a, b)]
    return sides[0].cogroup(sides[1]).applyInArrow(function, schema)


def trigram_candidates(incoming: DataFrame, forms: DataFrame, limit: int = 30) -> DataFrame:
    """(name, person, similarity): the best `limit` persons for each incoming name, ties to the smaller person.

    incoming: name. forms: person, form (its name and stored aliases, in words). A person takes part where a form is similar
    to the name by NAME_LEAST, or word-similar to one of its words by WORD_LEAST; the similarity is the best of all its
    forms that do, of the name or any word, to four places. Names and forms without a letter or digit have no candidates.

    A person among the best of a name by one of its words is among the best of that word, so words keep `limit` persons. A
    name that has so many by its words needs of the others only those whose whole names are as similar as the last of these.
    """
    units = materialize(_units(incoming), "asked-units")
    told = materialize(forms.select("person", "form").distinct(), "persons-forms")
    joined = lambda c: F.array_join(ordered_trigrams(F.col(c)), "")
    plain = told.groupBy("form").agg(F.min("person").alias("first")).select("form", joined("form").alias("ordered"), "first").filter("ordered <> ''")
    plain = materialize(plain, "form-trigrams")
    # how many persons have a word; a person is counted once for each of its words
    worded = told.select("person", F.explode(X.words(F.col("form"))).alias("form")).distinct()
    has = materialize(worded.groupBy("form").agg(F.count("*").alias("n")).select("form", joined("form").alias("ordered"), "n"), "form-words")
    deepest = lambda df: df.groupBy("person").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    words_each, forms_each = deepest(worded), deepest(told)
    trigrams = lambda whole: units.filter("whole" if whole else "not whole").select("unit").distinct().select("unit", F.array_join(F.array_distinct(ordered_trigrams(F.col("unit"))), "").alias("t")).filter("t <> ''")

    words = materialize(trigrams(False).withColumn("least", F.lit(WORD_LEAST)), "asked-words")
    reach = materialize(_meet(words, has, reaching(limit * words_each), "unit string, least double"), "word-reach").groupBy("unit").agg(F.max("least").alias("reach"))
    least = F.greatest(F.lit(WORD_LEAST), F.coalesce(F.col("reach") - 2 * ROUNDED, F.lit(WORD_LEAST)))
    words = materialize(words.drop("least").join(reach, "unit", "left").select("unit", "t", least.alias("least")), "near-words")
    good = materialize(_meet(words, plain, meeting(False, limit * forms_each), "unit string, form string, value double"), "word-forms")
    lists = _best(good.join(told, "form").select("unit", "person", F.round("value", 4).alias("similarity")), "unit", limit)
    by_word = materialize(_best(units.filter("not whole").select("name", "unit").join(lists, "unit").select("name", "person", "similarity"), "name", limit), "by-word")

    last = by_word.groupBy("name").agg(F.count("*").alias("n"), F.min("similarity").alias("last")).filter(F.col("n") >= limit)
    least = F.coalesce(F.greatest(F.col("last") - ROUNDED, F.lit(NAME_LEAST)), F.lit(NAME_LEAST))
    asked = materialize(trigrams(True).join(last.withColumnRenamed("name", "unit"), "unit", "left").select("unit", "t", least.alias("least")), "asked-names")
    own = F.filter(F.array_distinct(X.words(F.col("name"))), lambda w: F.length(w) >= WORD_LETTERS)
    sets = F.transform(own, lambda w: F.array_join(F.array_distinct(ordered_trigrams(w)), ""))
    near = _meet(asked, plain, meeting(True, None), "unit string, form string, value double").select(F.col("unit").alias("name"), "form", F.col("value").alias("alike"))
    weighed = materialize(near.select("name", "form", "alike", sets.alias("own"), joined("form").alias("joined")), "near-names")
    weighed = weighed.select("name", "form", "alike", _word_similarity("own", "joined").alias("of_word"))
    whole = weighed.select("name", "form", F.round(F.greatest("alike", "of_word"), 4).alias("similarity")).join(told, "form").select("name", "person", "similarity")
    return _best(by_word.unionByName(whole), "name", limit)


def key_candidates(incoming: DataFrame, forms: DataFrame, limit: int = 30) -> DataFrame:
    """(name, person, by_name, by_alias): persons one of whose forms has the name's key (its words in any order).

    forms: person, form, alias (boolean). Those by name come first, then the smaller person.
    """
    key = lambda c: F.array_join(F.array_sort(X.words(F.col(c))), "")
    keyed = forms.select("person", "alias", key("form").alias("key")).filter("key <> ''").groupBy("key", "person").agg(F.bool_or(~F.col("alias")).alias("by_name"), F.bool_or("alias").alias("by_alias"))
    met = incoming.select("name").distinct().withColumn("key", key("name")).join(keyed, "key").drop("key")
    order = F.row_number().over(Window.partitionBy("name").orderBy(F.col("by_name").desc(), "person"))
    return met.withColumn("_r", order).filter(F.col("_r") <= limit).drop("_r")


def merged_candidates(incoming: DataFrame, forms: DataFrame, limit: int = 30) -> DataFrame:
    """(name, person, sources, similarity): candidates by key, by alias and by trigrams as one list, `limit` for each name.

    Those by key or alias come first, then the most similar, then the smaller person. sources: in alphabetical order.
    """
    fuzzy = trigram_candidates(incoming, forms, limit).withColumns({"by_name": F.lit(False), "by_alias": F.lit(False), "fuzzy": F.lit(True)})
    exact = key_candidates(incoming, forms, limit).withColumns({"similarity": F.lit(None).cast("double"), "fuzzy": F.lit(False)})
    merged = fuzzy.unionByName(exact).groupBy("name", "person").agg(F.max("similarity").alias("similarity"), *[F.bool_or(c).alias(c) for c in ("by_name", "by_alias", "fuzzy")])
    sources = F.array_compact(F.array(F.when(F.col("by_alias"), "alias"), F.when(F.col("by_name"), "exact_key"), F.when(F.col("fuzzy"), "trigram")))
    order = F.row_number().over(Window.partitionBy("name").orderBy((F.col("by_name") | F.col("by_alias")).desc(), F.coalesce("similarity", F.lit(0.0)).desc(), "person"))
    return merged.withColumn("_r", order).filter(F.col("_r") <= limit).select("name", "person", F.array_join(sources, "+").alias("sources"), "similarity")
