"""Junk screen: a linear score over embeddings, its cascade, and what a purge takes away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(v: Column) -> Column:
    """The vector at length 1 (a zero vector stays)."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(doubles, lambda x: F.when(length > 0, x / length).otherwise(x))


def linear_score(v: Column, weights: Column, bias: float) -> Column:
    """sigmoid(v / |v| . w + b)."""
    dot = F.aggregate(F.zip_with(unit(v), weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return 1.0 / (1.0 + F.exp(-(dot + bias)))


def mean_difference(vectors: DataFrame, vector: str, positive: Column) -> DataFrame:
    """One row, weights: the mean of the positive unit vectors less that of the others. The sums are partial aggregates of one row for each dimension."""
    rows = vectors.select(positive.cast("int").alias("p"), F.posexplode(unit(F.col(vector))).alias("i", "x"))
    means = rows.groupBy("i").agg((F.avg(F.when(F.col("p") == 1, F.col("x"))) - F.avg(F.when(F.col("p") == 0, F.col("x")))).alias("w"))
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("weights"))


def cascade(first: Column, second: Column, low: float, high: float) -> Column:
    """junk, keep or hold: the first score decides outside (low, high), the second one inside."""
    return F.when(first >= high, "junk").when(first <= low, "keep").when(second >= 0.5, "junk").otherwise("hold")


def orphans(entities: DataFrame, key: str, links: Sequence[DataFrame]) -> DataFrame:
    """Entities that no link names any more."""
    for link in links:
        entities = entities.join(link.select(key), key, "left_anti")
    return entities


def train_logistic(vectors: DataFrame, vector: str, label: str) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression on unit vectors, by Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(unit(F.col(vector))).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(rows)
    return list(model.coefficients), float(model.intercept)
