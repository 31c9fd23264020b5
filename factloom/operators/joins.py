"""Joins with conditions beyond equality, each brought back to an equi-join on a bucket or block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """Pairs of equal keys whose numbers left_at and right_at are at most width apart.

    Both sides go by bucket of that width; the right side stands in three buckets, so a key's rows spread over as many
    tasks as it has buckets. Other column names must differ.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    a = left.withColumn("_b", bucket(left_at))
    b = right.withColumn("_b", F.explode(F.array(*[bucket(right_at) + d for d in (-1, 0, 1)])))
    near = F.abs(F.col(left_at) - F.col(right_at)) <= width
    return a.join(b, [*keys, "_b"]).filter(near).drop("_b")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, low: str, high: str, step: float) -> DataFrame:
    """Rows of equal keys where low <= value <= high; right's band is exploded into buckets of `step` (bands are short)."""
    a = left.withColumn("_b", F.floor(F.col(value) / step))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step))))
    return a.join(b, [*keys, "_b"]).filter(F.col(value).between(F.col(low), F.col(high))).drop("_b")


def previous_value(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The last known value of the group's earlier rows (carry forward); the row's own is not looked at."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """For each left row, `values` of the latest right row of its keys at or before left_at.

    One union and one window over (keys, time): no pair of rows is formed. Of right rows at one time the greatest counts.
    """
    mark = F.struct(F.col(right_at).alias("_at"), *values)
    a = left.withColumn("_time", F.col(left_at)).withColumn("_side", F.lit(1)).withColumn("_mark", F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType))
    b = right.select(*keys, F.col(right_at).alias("_time"), F.lit(0).alias("_side"), mark.alias("_mark"))
    w = Window.partitionBy(*keys).orderBy("_time", "_side", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_found", F.last("_mark", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def nearest_span(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """For each left span (id, start, end), the right spans (r_start, r_end) of equal keys at the least gap, at most `most`; ties stay."""
    gap = F.greatest(F.lit(0), F.col("r_start") - F.col("end"), F.col("start") - F.col("r_end"))
    pairs = left.join(right, list(keys)).withColumn("gap", gap).filter(F.col("gap") <= most)
    w = Window.partitionBy(*keys, "id")
    return pairs.withColumn("_least", F.min("gap").over(w)).filter("gap = _least").drop("_least")


def word_subset_join(left: DataFrame, right: DataFrame, left_words: str, right_words: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs whose word arrays contain one another: an inverted index on words, then a count of those in common."""
    a = left.select(left_id, F.size(left_words).alias("_n1"), F.explode(F.array_distinct(left_words)).alias("_w"))
    b = right.select(right_id, F.size(right_words).alias("_n2"), F.explode(F.array_distinct(right_words)).alias("_w"))
    common = a.join(b, "_w").groupBy(left_id, right_id, "_n1", "_n2").agg(F.count("*").alias("common"))
    return common.filter(F.col("common") == F.least("_n1", "_n2")).select(left_id, right_id, "common")


def first_tier(tiers: Sequence[DataFrame], key: str, order: Sequence[Column]) -> DataFrame:
    """Union of match tiers (best first); each key keeps the rows of the first tier that has it, the best of them."""
    all_ = None
    for number, tier in enumerate(tiers):
        tier = tier.withColumn("tier", F.lit(number))
        all_ = tier if all_ is None else all_.unionByName(tier)
    w = Window.partitionBy(key).orderBy("tier", *order)
    return all_.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
