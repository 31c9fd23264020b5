"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import materialize


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for each node of an edge: root is the least node that it reaches.

    A round sends each node's larger neighbours, then its smaller ones, to the least neighbour; edges don't grow in
    number, and rounds grow with the logarithm of the longest path. Least neighbours are partial aggregates joined back on
    the node. Each round is a written table. Self-loops name single nodes.
    """
    loops = edges.filter(F.col(left) == F.col(right)).select(F.col(left).alias("node")).distinct()
    now = edges.filter(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    now = materialize(now, "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below has a plain exchange on each side and Spark may split a node of many edges
        least = materialize(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "c")), "least")
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        now = materialize(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = roots.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    found = roots.unionByName(tops)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(alone)
