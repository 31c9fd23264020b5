"""Relational building blocks that the domain operators share. All are lazy and order-total: ties end in a named key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank. Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group (DISTINCT ON)."""
    return top_k_per_group(df, keys, order, 1, "_rank").drop("_rank")


def page_with_total(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page and the count of all rows. The count is an aggregate of one row, not a window over everything."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def unique_match_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows with their match, where exactly one right row has their keys; other left rows get nulls."""
    single = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    return left.join(single.filter("_n = 1").drop("_n"), list(keys), "left")


def priority_overlay(base: DataFrame, key: str, value: str, overlays: Sequence[tuple[str, DataFrame]], source: str) -> DataFrame:
    """`value` from the first overlay that has the key, else the base's own; `source` names where it came from.

    overlays: (name, table of key and value), the strongest word first. Keys of overlays are unique.
    """
    out, values, names = base, [], []
    for name, table in overlays:
        out = out.join(table.select(F.col(key), F.col(value).alias(f"_v_{name}")), key, "left")
        values.append(F.col(f"_v_{name}"))
        names.append(F.when(F.col(f"_v_{name}").isNotNull(), F.lit(name)))
    return (
        out.withColumn(source, F.coalesce(*names, F.lit("base")))
        .withColumn(value, F.coalesce(*values, F.col(value)))
        .drop(*[f"_v_{n}" for n, _ in overlays])
    )


def mode_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each group's most frequent value and its count; ties to the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), value)))
    return ranked.filter("_r = 1").drop("_r")


def histogram(df: DataFrame, keys: Sequence[str], value: str, name: str = "variants") -> DataFrame:
    """Per group, an array of (value, n), the most frequent first, ties by value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col(value).alias("value"))))
    return counts.groupBy(*keys).agg(F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), (-p["order"]).alias("n"))).alias(name))


def sum_maps(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Merge maps of counts by adding the values of equal keys."""
    rows = df.select(*keys, F.explode(column).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(column))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """p50, p95, ... by the nearest-rank rule: the value at place ceil(p n / 100) of the sorted ones.

    Counts of equal values are summed before they are ordered, so a group's window holds its distinct values only.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)
    run = counts.withColumn("_upto", F.sum("_n").over(by.orderBy(value))).withColumn("_all", F.sum("_n").over(by))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col(value))).alias(f"p{p}") for p in percents])


def leading_run(df: DataFrame, keys: Sequence[str], order: Sequence[Column], holds: Column, name: str = "streak") -> DataFrame:
    """Per group, how many rows from the first on fulfil `holds` before one does not."""
    w = Window.partitionBy(*keys).orderBy(*order)
    broken = df.withColumn("_broken", F.sum(F.when(holds, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return broken.groupBy(*keys).agg(F.count_if(F.col("_broken") == 0).alias(name))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Per group, the unions of intervals that overlap or are at most `gap` apart, with the number merged."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def group_statistics(df: DataFrame, key: str, months: str, support: int = 1) -> tuple[DataFrame, DataFrame]:
    """Per known key: cases, those with a term, mean, median and longest term in years; and the row of the unknown key."""
    known = F.col(key).isNotNull() & (F.col(key) != "")
    term = F.when(F.col(months) > 0, F.col(months))
    stats = [
        F.count("*").alias("cases"),
        F.count(term).alias("imprisoned"),
        F.round(F.avg(term) / 12, 1).alias("mean_years"),
        F.round(F.median(term) / 12, 1).alias("median_years"),
        F.round(F.max(term) / 12.0, 1).alias("max_years"),
    ]
    return df.filter(known).groupBy(key).agg(*stats).filter(F.col("cases") >= support), df.filter(~known).agg(*stats)
