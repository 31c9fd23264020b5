"""What the operators of this package share: reading a table, spreading rows, and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.storage import materialize, shared_folder

__all__ = ["gapless", "materialize", "shared_folder", "spread", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly where the input has few partitions, which would keep most cores idle.

    Rows go by their place, not by a key, so that rows that repeat a key (or have none) are dealt out like all others. An
    input of many partitions, as large tables have, is left alone: no shuffle there.
    """
    if df.rdd.getNumPartitions() >= 4 * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition("_place").drop("_place")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def gapless(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str, buckets: int, copies: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, as column `name` (long), by bucket, then `order`.

    copies: a column that says how many equal rows a row stands for; these are given a number each. Rows are numbered
    inside (group, bucket) windows and moved by the counts of the group's earlier buckets, so no task holds a whole group.
    The counts are buckets x groups rows at most (the caller's groups are few), which bounds the broadcast. df is read
    twice: materialize it if it is dear.
    """
    placed = df.withColumn("_bucket", bucket).withColumn("_copies", F.col(copies).cast("long") if copies else F.lit(1).cast("long"))
    counts = placed.groupBy(*groups, "_bucket").agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_row", F.coalesce(F.sum("_copies").over(inside), F.lit(0)) if copies else F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(*order)).cast("long") - 1)
    numbered = numbered.join(F.broadcast(starts), [*groups, "_bucket"]).withColumn(name, F.col("_row") + F.col("_start"))
    if copies:
        numbered = numbered.drop(copies).withColumn(name, F.explode(F.sequence(F.col(name), F.col(name) + F.col("_copies") - 1)))
    return numbered.drop("_bucket", "_row", "_start", "_copies")
