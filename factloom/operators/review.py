"""Decisions over time: holds and junk, reviews, precedence of verdicts, what a base knows, and what is shown of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.relational import latest_by
from factloom.storage import materialize

#: What each action makes of a state; others leave it as it is.
HOLD_STEPS = {("none", "hold"): "held", ("held", "mark_junk"): "junk", ("held", "release"): "released", ("released", "unrelease"): "junk"}


def hold_states(actions: DataFrame, key: str, order: Sequence[str], action: str) -> DataFrame:
    """(key, state): the actions of each key in order, folded by HOLD_STEPS. A page opened before a release undoes nothing."""
    steps = F.sort_array(F.collect_list(F.struct(*order, F.col(action).alias("a"))))
    step = lambda state, x: F.coalesce(*[F.when((state == s) & (x["a"] == a), F.lit(t)) for (s, a), t in HOLD_STEPS.items()], state)
    return actions.groupBy(key).agg(steps.alias("_s")).select(key, F.aggregate("_s", F.lit("none"), step).alias("state"))


def junk(runs: DataFrame, events: DataFrame, holds: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(article): those whose latest successful run (run, article, status) found no event (run, type) of the kinds, held and released ones aside."""
    latest = latest_by(runs.filter("status = 'succeeded'"), ["article"], [F.col("run").desc()]).select("run", "article")
    charged = events.filter(F.col("type").isin(list(kinds))).select("run").distinct()
    kept = holds.filter(F.col("state").isin("held", "released")).select("article")
    return latest.join(charged, "run", "left_anti").join(kept, "article", "left_anti").select("article")


def apply_reviews(links: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mention, person, decided_by) after reviews, and the pairs (a, b) of persons known to be distinct.

    links: mention, person. reviews: mention, action (link, create, keep_separate, reject), person, distinct_from, at. The
    last review of a mention counts; a created person is numbered by its mention.
    """
    last = latest_by(reviews, ["mention"], [F.col("at").desc()])
    person = F.when(F.col("action") == "link", F.col("r_person")).when(F.col("action").isin("create", "keep_separate"), -1 - F.col("mention")).when(F.col("action") == "reject", F.lit(None).cast("long")).otherwise(F.col("person"))
    out = links.join(last.select("mention", "action", F.col("person").alias("r_person")), "mention", "left")
    out = out.select("mention", person.alias("person"), F.when(F.col("action").isNotNull(), "review").otherwise("rule").alias("decided_by"))
    pairs = last.filter("action = 'keep_separate' and distinct_from is not null").select(F.least(F.col("distinct_from"), -1 - F.col("mention")).alias("a"), F.greatest(F.col("distinct_from"), -1 - F.col("mention")).alias("b"))
    return out, pairs.distinct()


def may_be_alias(name_words: Column, surname: Column, given: Column, patronymic: Column, conflict: Column) -> Column:
    """A form is kept as an alias if it is two full words or more, without conflict, with equal surname and given name and no doubtful patronymic."""
    full = F.forall(name_words, lambda w: F.length(w) > 1) & (F.size(name_words) >= 2)
    return full & ~conflict & (surname == "exact") & (given == "exact") & patronymic.isin("exact", "missing")


def first_known(verdicts: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """The verdict of the first method that has one, and that method's name."""
    return F.coalesce(*[v for _, v in verdicts]), F.coalesce(*[F.when(v.isNotNull(), name) for name, v in verdicts])


#: Words up to which a name is taken apart into all its parts of two words and more; longer ones meet on single words.
PARTED = 8


def _parts(words: Column) -> Column:
    """The sets of two words or more that a sorted array of up to PARTED distinct words holds, each sorted."""
    has = lambda mask, i: (F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1))) == 1
    masks = F.filter(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1), lambda m: F.bit_count(m) >= 2)
    return F.transform(masks, lambda m: F.filter(words, lambda w, i: has(m, i)))


def base_levels(asked: DataFrame, base: DataFrame) -> DataFrame:
    """(person, level, records) of names (person, words) that a base (record, words) may hold.

    A record fits where the shorter name's words all stand in the longer one (two words at least). in_base: one record is
    equal and either the name has three words or nothing else fits; probably: one fits; namesakes: several do. Records are
    counted by their set of words, and what fits is counted without a pair of name and record: a set meets those that it
    holds by its own parts, and those that hold it by theirs. Only names of more than PARTED words meet sets on single words.
    """
    tidy = lambda df, c: df.select(c, F.array_sort(F.array_distinct("words")).alias("words")).filter(F.size("words") >= 2).distinct()
    mine, held = tidy(asked, "person"), materialize(tidy(base, "record").groupBy("words").agg(F.count("*").alias("n")), "held")
    names, short = materialize(mine.select("words").distinct(), "asked-names"), F.size("words") <= PARTED
    own = names.filter(short).select("words", F.explode(_parts(F.col("words"))).alias("part")).filter("part <> words")
    below = own.join(held.select(F.col("words").alias("part"), "n"), "part").select("words", "n", F.lit(0).alias("equal"))
    theirs = held.filter(short).select(F.explode(_parts(F.col("words"))).alias("part"), "words", "n")
    above = theirs.select(F.col("part").alias("words"), "n", F.when(F.col("part") == F.col("words"), F.col("n")).otherwise(0).alias("equal"))

    each = lambda df, c: df.select(F.col("words").alias(c), *[x for x in df.columns if x != "words"], F.explode("words").alias("w"))
    long = lambda df: df.filter(~short)
    met = each(long(names), "a").join(each(held, "b"), "w").unionByName(each(names.filter(short), "a").join(each(long(held), "b"), "w"))
    common = met.groupBy("a", "b", "n").agg(F.count("*").alias("common")).filter(F.col("common") == F.least(F.size("a"), F.size("b")))
    common = common.select(F.col("a").alias("words"), "n", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("equal"))

    sums = [F.sum("equal").alias("exact"), F.sum("n").alias("records")]
    fits = materialize(below.unionByName(above).unionByName(common).groupBy("words").agg(*sums), "fits")  # plain exchanges: a name of many persons is split
    counted = mine.join(fits, "words").groupBy("person").agg(F.sum("exact").alias("exact"), F.sum("records").alias("records"), F.min(F.size("words")).alias("n"))
    level = F.when((F.col("exact") == 1) & ((F.col("n") >= 3) | (F.col("records") == 1)), "in_base").when(F.col("records") == 1, "probably").otherwise("namesakes")
    return counted.select("person", level.alias("level"), F.when(level == "in_base", 1).otherwise(F.col("records")).cast("long").alias("records"))


def swapped_names(names: DataFrame) -> DataFrame:
    """(name, into): two-word names of which the reverse is mentioned too become the more frequent order (ties: the lesser).

    names: name, mentions.
    """
    key = F.array_join(F.array_sort(F.split("name", " ")), " ")
    two = names.filter(F.size(F.split("name", " ")) == 2).withColumn("key", key)
    w = Window.partitionBy("key").orderBy(F.col("mentions").desc(), "name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return two.withColumn("into", F.first("name").over(w)).filter(F.col("name") != F.col("into")).select("name", "into")


def supported_groups(counts: DataFrame, group: str, n: str, support: int, tail: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of `support` and more, the `tail` largest of the smaller ones, and the unknown group, each (group, n).

    counts: one row a group; a null or empty group is the unknown one.
    """
    named = F.coalesce(F.col(group), F.lit("")) != ""
    unknown = counts.filter(~named).agg(F.coalesce(F.sum(n), F.lit(0)).alias(n)).select(F.lit(None).cast("string").alias(group), n)
    return counts.filter(named & (F.col(n) >= support)).select(group, n), counts.filter(named & (F.col(n) < support)).orderBy(F.col(n).desc(), group).limit(tail).select(group, n), unknown


def not_in(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not null and not among the excluded ones: NOT IN without its trap, where one excluded null leaves no row."""
    return df.filter(F.col(key).isNotNull()).join(excluded.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def best_hits(hits: Sequence[DataFrame], key: str, score: str, limit: int) -> DataFrame:
    """(key, score): the best score of each key over several hit lists, the `limit` best keys."""
    every = hits[0].select(key, score)
    for h in hits[1:]:
        every = every.unionByName(h.select(key, score))
    return every.groupBy(key).agg(F.max(score).alias(score)).orderBy(F.col(score).desc(), key).limit(limit)


def effective_latest(events: DataFrame, person: str, event: str, happened: str, published: str) -> DataFrame:
    """The latest event of each person by the day it happened, or else was published; an unknown day stays null in the result."""
    day = F.coalesce(happened, published)
    return latest_by(events, [person], [F.to_date(day).desc_nulls_last(), F.col(event).desc()])


def json_rows(df: DataFrame, keys: Sequence[str], json: str, schema: str, name: str = "item") -> DataFrame:
    """A row for each element of a JSON array of objects, with its place; null or broken JSON has none."""
    return df.select(*keys, F.posexplode(F.from_json(json, f"array<struct<{schema}>>")).alias("place", name)).select(*keys, "place", f"{name}.*")


def layout_change(runs: DataFrame, source: str, order: Column, parsed: str, fetched: str, least_share: float, least_runs: int) -> DataFrame:
    """(source, share, silent, changed): parsed pages of all fetched ones, the latest runs in a row that parsed none, and
    whether the source's layout seems to have changed."""
    w = Window.partitionBy(source).orderBy(order)
    ranked = runs.withColumn("_r", F.row_number().over(w)).withColumn("_hit", F.min(F.when(F.col(parsed) > 0, F.col("_r"))).over(Window.partitionBy(source)))
    out = ranked.groupBy(source).agg(F.try_divide(F.sum(parsed), F.sum(fetched)).alias("share"), F.count_if(F.col("_hit").isNull() | (F.col("_r") < F.col("_hit"))).alias("silent"))
    return out.withColumn("changed", (F.coalesce("share", F.lit(0.0)) < least_share) | (F.col("silent") >= least_runs))


def canonical(names: DataFrame, column: str, lookup: Mapping[str, str], into: str) -> DataFrame:
    """names with the canonical spelling of `column`: a lookup on its slug (letters and digits, joined by hyphens)."""
    spark = names.sparkSession
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    table = spark.createDataFrame(sorted(lookup.items()), f"_slug string, {into} string")
    return names.withColumn("_slug", slug).join(F.broadcast(table), "_slug", "left").withColumn(into, F.coalesce(into, "_slug")).drop("_slug")
