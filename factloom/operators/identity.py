"""Grouping of mentions into persons, merging, and resolution in batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators.graph import components
from factloom.storage import materialize

#: What a surname's case adds to its stem, as (ending, what takes its place), because one expression reads all of
#: them; and the shortest stem.
RUSSIAN_ENDINGS: tuple[tuple[str, str], ...] = (
    ("а", ""), ("я", ""), ("у", ""), ("ю", ""), ("е", ""), ("ом", ""), ("ем", ""), ("ым", ""), ("им", ""), ("ой", ""), ("ей", ""), ("ы", ""), ("и", ""), ("ь", ""),
    ("ый", ""), ("ого", ""), ("ому", ""), ("ая", ""), ("ую", ""), ("ий", "ь"), ("его", "ь"), ("ему", "ь"), ("яя", "ь"), ("юю", "ь"),
    ("овых", "ов"), ("евых", "ев"), ("иных", "ин"), ("ыных", "ын"),
)
SHORTEST_STEM = 3


def bases(word: Column, endings: Sequence[tuple[str, str]] = RUSSIAN_ENDINGS) -> Column:
    """The word, and what it would be without each ending that it may carry."""
    table = F.array(*[F.struct(F.lit(e).alias("ending"), F.lit(i).alias("instead")) for e, i in endings])

    def without(e: Column) -> Column:
        stem = F.left(word, F.length(word) - F.length(e["ending"]))
        whole = F.length(stem) + F.when(F.startswith(e["ending"], e["instead"]), F.length(e["instead"])).otherwise(0)  # a plural keeps letters
        return F.when(F.endswith(word, e["ending"]) & (whole >= SHORTEST_STEM), F.concat(stem, e["instead"]))

    return F.array_distinct(F.concat(F.array(word), F.filter(F.transform(table, without), lambda b: b.isNotNull())))


def _node(scope: Column, word: Column) -> Column:
    """Text that sorts by scope, then the shorter word, then the alphabet."""
    return F.concat(scope, F.lit("\u0001"), F.lpad(F.length(word).cast("string"), 4, "0"), word)


def surname_roots(surnames: DataFrame, scope: str, surname: str, endings: Sequence[tuple[str, str]] = RUSSIAN_ENDINGS) -> DataFrame:
    """(scope, surname, root): surnames of a scope (a given name) that share a base are one, named by the shortest base."""
    one = surnames.select(scope, surname).distinct()
    edges = one.select(_node(F.col(scope), F.col(surname)).alias("a"), F.explode(F.transform(bases(F.col(surname), endings), lambda b: _node(F.col(scope), b))).alias("b"))
    found = components(edges)
    named = one.withColumn("node", _node(F.col(scope), F.col(surname))).join(found, "node")
    return named.select(scope, surname, F.substring(F.substring_index("root", "\u0001", -1), 5, 1000).alias("root"))


def group_mentions(mentions: DataFrame, endings: Sequence[tuple[str, str]] = RUSSIAN_ENDINGS) -> DataFrame:
    """(mention, key): the person of each mention (mention, article, first, last, patronymic, region), or null.

    Full names go by given name, patronymic's stem, surname's root and a card's region. A patronymic without a region joins
    the one card of its name; a name without a patronymic joins the one person of it in its article; a bare surname or
    initial joins the one person in its article whose forms it shares. Where two would do, nobody's. All are equi-joins.
    """
    nothing = F.lit("")
    folded = mentions.select("mention", "article", *[X.fold(F.coalesce(c, nothing)).alias(c) for c in ("first", "last", "patronymic", "region")])
    folded = folded.withColumns({f"b_{c}": bases(F.col(c), endings) for c in ("first", "last", "patronymic")})
    again = F.arrays_overlap("b_first", "b_last") & (F.col("first") != "")
    folded = folded.withColumns({"first": F.when(again, "").otherwise(F.col("first")), "patronymic": F.when(again, "").otherwise(F.col("patronymic"))})
    short = F.array_min(F.transform("b_patronymic", lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))))["b"]
    folded = folded.withColumn("father", F.when(F.col("patronymic") != "", short).otherwise("")).drop("b_first", "b_patronymic")
    folded = materialize(folded, "mentions")
    initial = F.length(F.rtrim(F.col("first"), F.lit("."))) <= 1
    full = folded.filter((F.col("last") != "") & ~initial)
    full = full.join(surname_roots(full, "first", "last", endings), ["first", "last"])
    full = materialize(full.withColumn("name", F.concat_ws(" ", "first", F.nullif("father", nothing), "root")), "full-names")
    cards = full.filter("father <> '' and region <> ''").groupBy("name").agg(F.min("region").alias("card"), F.count_distinct("region").alias("cards"))
    fathers = full.filter("father <> ''").join(cards, "name", "left")
    region = F.when(F.col("region") != "", F.col("region")).when(F.col("cards") == 1, F.col("card"))
    kept = ["mention", "article", "first", "b_last", "root", "key"]
    fathers = fathers.withColumn("key", F.concat_ws(" · ", "name", region)).select(*kept)
    known = fathers.groupBy("article", "first", "root").agg(F.min("key").alias("only"), F.count_distinct("key").alias("n"))
    rest = full.filter("father = ''").join(known, ["article", "first", "root"], "left")
    rest = rest.withColumn("key", F.when(F.col("n") == 1, F.col("only")).otherwise(F.concat_ws(" ", "first", "root"))).select(*kept)
    placed = materialize(fathers.unionByName(rest), "placed")
    forms = placed.select("article", "key", "first", F.explode(F.array_distinct(F.concat("b_last", F.array("root")))).alias("form")).distinct()
    bare = folded.filter((F.col("last") != "") & initial).select("mention", "article", F.col("first").alias("initial"), F.explode("b_last").alias("form"))
    met = bare.join(forms, ["article", "form"]).filter((F.col("initial") == "") | F.startswith("first", F.left("initial", F.lit(1))))
    single = met.groupBy("mention").agg(F.min("key").alias("key"), F.count_distinct("key").alias("n")).filter("n = 1").select("mention", "key")
    return mentions.select("mention").join(placed.select("mention", "key").unionByName(single), "mention", "left")


def merge_people(persons: DataFrame, facts: Mapping[str, DataFrame], person: str = "person", into: str = "merged_into") -> dict[str, DataFrame]:
    """Facts moved to the person that theirs was merged into, through any chain, each fact once.

    A merge chain ends in the one person that was not merged; chains are components, and that person names them.
    """
    edges = persons.select(F.col(person).alias("a"), F.coalesce(into, person).alias("b"))
    roots = components(edges)
    ends = roots.join(persons.filter(F.col(into).isNull()).select(F.col(person).alias("node"), F.col(person).alias("end")), "node").select("root", "end")
    final = roots.join(ends, "root").select(F.col("node").alias(person), "end")
    return {name: f.join(final, person, "left").withColumn(person, F.coalesce("end", person)).drop("end").dropDuplicates() for name, f in facts.items()}


def resolve_batch(mentions: DataFrame, linked: DataFrame, order: Sequence[str]) -> DataFrame:
    """(mention, person, how) with batch semantics in place of an order-dependent loop.

    mentions: mention, key (of the full name), full (boolean), and the columns of `order`. linked: mention, person, of those
    resolved against stored persons. The rest: the first mention of each key, in the canonical order, creates the person
    (numbered by that mention) to whom the key's other mentions link; names that are no full identity wait for review.
    The result does not depend on partitions, and a second run over stored persons gives the same links.
    """
    known = mentions.join(linked, "mention", "left")
    fresh = known.filter(F.col("person").isNull() & F.col("full"))
    firsts = fresh.groupBy("key").agg(F.min(F.struct(*order, F.col("mention").alias("creator"))).alias("m")).select("key", "m.creator")
    out = known.join(firsts, "key", "left")
    made = F.col("person").isNull() & F.col("full")
    how = F.when(F.col("person").isNotNull(), "linked").when(~F.col("full"), "review").when(F.col("creator") == F.col("mention"), "created").otherwise("same_batch")
    return out.select("mention", F.when(made, F.col("creator")).otherwise(F.col("person")).alias("person"), made.alias("new"), how.alias("how"))


def merge_decided(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, into): entities that decided pairs (a, b) tie together become the most mentioned of them (ties: the smaller key)."""
    groups = components(pairs.select("a", "b")).select(F.col("node").alias("key"), "root").join(entities.select("key", "mentions"), "key")
    w = Window.partitionBy("root").orderBy(F.col("mentions").desc(), "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return groups.select("key", F.first("key").over(w).alias("into"))


def clear_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of which each side stands in no other pair."""
    ends = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("n")).filter("n = 1").select("key")
    return pairs.join(ends.withColumnRenamed("key", "a"), "a", "left_semi").join(ends.withColumnRenamed("key", "b"), "b", "left_semi").select("a", "b")


def officials(mentions: DataFrame, title: str, former: str) -> DataFrame:
    """Persons with a title before the name in two mentions or more, or in at least half of them; a former title never counts.

    mentions: key, before (the text in front of the name).
    """
    titled = F.regexp_like("before", F.lit(title)) & ~F.regexp_like("before", F.lit(former))
    counts = mentions.groupBy("key").agg(F.count("*").alias("mentions"), F.count_if(titled).alias("titled"))
    return counts.filter((F.col("titled") >= 2) | ((F.col("titled") > 0) & (F.col("titled") * 2 >= F.col("mentions"))))


def unnamed_once(sentences: DataFrame) -> DataFrame:
    """Described persons of an article once for each (age, sex, place, initial): the first sentence stays."""
    w = Window.partitionBy("article", "age", "sex", "place", "initial").orderBy("start")
    return sentences.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
