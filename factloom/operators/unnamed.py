"""Described persons without a name: candidates from lists and from other publications, cases, and court hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import joins as J
from factloom.operators import relational as R


def list_candidates(unnamed: DataFrame, entries: DataFrame, keys: Sequence[str], shown: int = 10) -> DataFrame:
    """The entries that an unnamed person may be: of the age told, or a year older (the event may be earlier than the news).

    unnamed: id, age, on (date), place and keys. entries: entry, birth (date), birth_place and keys (sex, initial). Ages
    become bands of birth days, an equi-join on keys and years. Those born where the text says come first, then the
    exact age; `found` counts all.
    """
    day = lambda c: F.date_diff(c, F.lit("1900-01-01").cast("date"))
    asked = unnamed.filter(F.col("age").isNotNull() & F.col("on").isNotNull())
    asked = asked.withColumn("low", day(F.add_months("on", -12 * (F.col("age") + 2))) - 1).withColumn("high", day(F.add_months("on", -12 * F.col("age"))) + 1)
    met = J.band_join(entries.withColumn("born", day(F.col("birth"))), asked, list(keys), "born", "low", "high", 366)
    met = met.withColumn("exact_age", X.age_at(F.col("birth"), F.col("on"))).filter(F.col("exact_age").between(F.col("age"), F.col("age") + 1))
    met = met.withColumn("in_place", F.coalesce(F.contains(F.lower("birth_place"), F.lower("place")), F.lit(False)))
    met = met.withColumn("found", F.count("*").over(Window.partitionBy("id")))
    order = [F.col("in_place").desc(), (F.col("exact_age") == F.col("age")).desc(), F.col("entry")]
    return R.top_k_per_group(met, ["id"], order, shown).select("id", "rank", "entry", "exact_age", "in_place", "found")


def attach_unnamed(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, case) of the unnamed rows. A row with a signature (region, term, date to its precision) joins the one case that has
    it, else the other rows of that signature; a row without a date joins the one case of its region and term; else it
    is a case of its own. Cases are named by their least id.

    rows: id, region, term, on, exact (characters of the date that count). cases: id, case, and the same columns.
    """
    place = F.when((F.col("region") != "") & F.col("term").isNotNull(), F.concat_ws("|", "region", F.col("term").cast("string")))
    signed = lambda df: df.withColumn("place", place).withColumn("sign", F.concat(F.col("place"), F.lit("|"), X.iso_prefix(F.col("on"), F.col("exact"))))
    rows, cases = signed(rows), signed(cases)
    of_sign = cases.filter("sign is not null").groupBy("sign").agg(F.min("case").alias("only"), F.count_distinct("case").alias("n"))
    fresh = rows.filter("sign is not null").groupBy("sign").agg(F.min("id").alias("new"))
    dated = rows.filter("sign is not null").join(of_sign, "sign", "left").join(fresh, "sign")
    dated = dated.select("id", "place", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("new")).alias("case"))
    known = cases.select("place", "case").unionByName(dated.select("place", "case")).filter("place is not null").groupBy("place").agg(F.min("case").alias("only"), F.count_distinct("case").alias("n"))
    undated = rows.filter("sign is null").join(known, "place", "left").select("id", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("id")).alias("case"))
    return dated.select("id", "case").unionByName(undated)


def court_hints(described: DataFrame, sentences: DataFrame, keys: Sequence[str], shown: int = 3) -> DataFrame:
    """Courts that sentences of equal keys name, the most frequent first. described: id and keys; sentences: courts (array) and keys."""
    named = sentences.select(*keys, F.explode(F.array_distinct("courts")).alias("court")).groupBy(*keys, "court").agg(F.count("*").alias("n"))
    best = R.top_k_per_group(named, list(keys), [F.col("n").desc(), F.col("court")], shown)  # before the join: keys of many courts and many descriptions don't multiply
    return described.join(best, list(keys)).select("id", "rank", "court", "n")


def carried_age(told: DataFrame) -> DataFrame:
    """told (age, told_on, on) with the least and greatest age on `on`: the age goes on by the years elapsed, a year either way."""
    years = F.floor(F.date_diff("on", "told_on") / 365.25).cast("int")
    return told.withColumn("age_low", F.col("age") + years - 1).withColumn("age_high", F.col("age") + years + 1)


def until_known(listing: DataFrame, known: DataFrame, source: str, page: str, key: str) -> DataFrame:
    """What an incremental crawl reads: the pages of each source before the first whose every item is known, and on them the new items."""
    marked = listing.dropDuplicates([source, key]).join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left")
    stops = marked.groupBy(source, page).agg(F.bool_and(F.col("_k").isNotNull()).alias("all")).filter("all").groupBy(source).agg(F.min(page).alias("_stop"))
    open_ = marked.join(stops, source, "left").filter(F.col("_stop").isNull() | (F.col(page) < F.col("_stop")))
    return open_.filter(F.col("_k").isNull()).select(*listing.columns)
