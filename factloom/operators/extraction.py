"""Span-anchored mentions of texts: one Arrow function for each batch, spans in code points, checked against the text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<entity_type:string,surface:string,start:int,end:int>>"


def spans(text: str, patterns: Mapping[str, str]) -> list[tuple[str, str, int, int]]:
    """All matches by kind; of overlapping ones of a kind the leftmost; sorted by place, the longer first."""
    found = [(kind, m[0], m.start(), m.end()) for kind, p in patterns.items() for m in re.finditer(p, text)]
    return sorted(found, key=lambda s: (s[2], -s[3], s[0]))


def extract(docs: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """docs with mentions; patterns: kind -> regular expression, as data."""
    table = dict(patterns)

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("entity_type", "surface", "start", "end"), s, strict=True)) for s in spans(t or "", table)] for t in batch])

    return docs.withColumn("mentions", find(F.col(text)))


def invalid_spans(text: Column, mentions: Column) -> Column:
    """Mentions that the text doesn't hold at their place; a run with any is failed, not raised."""
    return F.filter(mentions, lambda m: (m["start"] >= m["end"]) | (F.substring(text, m["start"] + 1, m["end"] - m["start"]) != m["surface"]))


def mentions_table(extracted: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each valid mention of each run that has no invalid one; the others are rows of status failed."""
    marked = extracted.withColumn("status", F.when(F.size(invalid_spans(F.col(text), F.col("mentions"))) > 0, "failed").otherwise("succeeded"))
    rows = F.when(F.col("status") == "succeeded", F.col("mentions")).otherwise(F.array().cast(SPANS))
    return marked.select(key, "status", F.posexplode_outer(rows).alias("mention", "m")).select(key, "status", "mention", "m.*")


def sentences(text: Column) -> Column:
    """Sentences, trimmed: cut behind . ! ? and white space, but not after an initial or a one-letter abbreviation."""
    cut = F.split(F.regexp_replace(text, r"(?<![\s.(]\p{L})([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take the place as what to trim


def score_spans(predicted: DataFrame, golden: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 on exact spans, in one row.

    Spans of both sides are dealt out by their keys before they are grouped, so no task groups all those of its texts.
    """
    p, g = predicted.select(*keys, F.lit(True).alias("_p")), golden.select(*keys, F.lit(False).alias("_p"))
    each = p.unionByName(g).repartition(*keys).groupBy(*keys).agg(F.bool_or("_p").alias("p"), F.bool_or(~F.col("_p")).alias("g"))
    told = F.array_size(F.array_compact(F.array(*keys))) == len(keys)  # what isn't known equals nothing
    n = each.agg(F.count_if(F.col("p") & F.col("g") & told).alias("hit"), F.count_if("p").alias("p"), F.count_if("g").alias("g"))
    precision, recall = F.try_divide("hit", "p"), F.try_divide("hit", "g")
    return n.select("hit", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))
