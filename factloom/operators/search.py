"""Ranked text search over an inverted index, rank fusion, and quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X


def inverted_index(docs: DataFrame, key: str, text: str, only: Sequence[str] | None = None) -> DataFrame:
    """(term, key, tf, dl): how often each document has each term (of `only`, if given), and its length in terms."""
    terms = docs.select(key, X.words(F.col(text)).alias("_w"))
    if only is not None:
        terms = terms.select(key, F.size("_w").cast("long").alias("dl"), F.filter("_w", lambda w: w.isin(list(only))).alias("_w")).filter(F.size("_w") > 0)
    else:
        terms = terms.withColumn("dl", F.size("_w").cast("long"))
    return terms.select(key, "dl", F.explode("_w").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def tf_idf_search(index: DataFrame, documents: int, query: Sequence[str], key: str, require: Sequence[str] = ()) -> DataFrame:
    """Documents that hold any query term (and all of `require`), by the sum of tf / dl * ln(1 + N / df); ties by key."""
    wanted = [*dict.fromkeys([*query, *require])]
    hits = index.filter(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") / F.col("dl") * F.log1p(F.lit(float(documents)) / F.col("df"))
    scored = hits.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(weight).alias("score"), F.count_if(F.col("term").isin([*require])).alias("_required"))
    return scored.filter(F.col("_required") == len(set(require))).drop("_required")


def reciprocal_rank_fusion(lists: DataFrame, query: str, key: str, score: str, k: int = 60) -> DataFrame:
    """Fuse ranked lists: the sum of 1 / (k + rank) over the lists in which a document stands, each list once."""
    once = lists.groupBy(query, key).agg(F.max(score).alias(score))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), key))
    return once.withColumn("_r", rank).groupBy(key).agg(F.sum(1.0 / (k + F.col("_r"))).alias("fused"), F.count("*").alias("lists"))


def prefix_search(docs: DataFrame, documents: int, key: str, text: str, words: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Documents that hold any of the words and any term with one of the prefixes, by the sum of tf / dl * ln(1 + N / df).

    A prefix counts as one term. Terms that nobody asks for are dropped inside the document, before any row is made.
    """
    terms = X.words(F.col(text))
    name = lambda w: F.coalesce(*[F.when(F.startswith(w, F.lit(p)), F.lit(f"{p}*")) for p in prefixes], F.when(w.isin(list(words)), w))
    held = docs.select(key, terms.alias("_w")).select(key, F.size("_w").cast("long").alias("dl"), F.filter(F.transform("_w", name), lambda w: w.isNotNull()).alias("_t"))
    index = held.filter(F.size("_t") > 0).select(key, "dl", F.explode("_t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") / F.col("dl") * F.log1p(F.lit(float(documents)) / F.col("df"))
    starred = F.endswith("term", F.lit("*"))
    scored = index.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(weight).alias("score"), F.bool_or(starred).alias("_p"), F.bool_or(~starred).alias("_w"))
    return scored.filter(F.col("_p") & F.col("_w")).drop("_p", "_w")


def any_word(docs: DataFrame, key: str, text: str, terms: Sequence[str], around: int = 80) -> DataFrame:
    """(key, headline) of documents whose whole text holds any of the terms as a whole word: the fragment around the first
    hit, which stands between marks."""
    pattern = r"(^|[^\p{L}\p{N}])(" + "|".join(terms) + r")(?=[^\p{L}\p{N}]|$)"
    found = docs.select(key, F.col(text).alias("_t"), F.lower(text).alias("_l")).filter(F.col("_l").rlike(pattern))
    before = F.get(F.split("_l", pattern, 2), F.lit(0))
    led = F.length(F.regexp_extract("_l", pattern, 1))
    found = found.withColumn("_at", F.length(before) + led + 1).withColumn("_n", F.length(F.regexp_extract("_l", pattern, 2)))
    start = F.greatest(F.lit(1), F.col("_at") - around)
    part = lambda at, n: F.substring(F.col("_t"), at, n)
    return found.select(key, F.concat(part(start, F.col("_at") - start), F.lit("["), part(F.col("_at"), F.col("_n")), F.lit("]"), part(F.col("_at") + F.col("_n"), F.lit(around))).alias("headline"))
