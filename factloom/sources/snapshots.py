"""List snapshots from CSV, JSON, XML and HTML files, and what a landing table does with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.sources.html import article_of


def read_list(spark: SparkSession, path: str, kind: str, row_tag: str = "entry") -> DataFrame:
    """The entries of list files. kind: csv (with header), json (lines), xml (row_tag), or html (a row for each line of text)."""
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "json":
        return spark.read.json(path)
    if kind == "xml":
        return spark.read.option("rowTag", row_tag).xml(path)
    if kind == "html":
        pages = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))
        return pages.select("path", F.posexplode(F.split(article_of(F.col("html"))["body"], "\n")).alias("line", "text"))
    raise ValueError(f"kind {kind!r}")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: external_id, url, title, published_at (null where the date can't be read), text."""
    items = spark.read.option("rowTag", "item").schema("guid string, link string, title string, pubDate string, description string").xml(path)
    day = F.regexp_replace(F.trim("pubDate"), r"^[A-Za-z]{3},\s*", "")
    when = F.coalesce(*[F.try_to_timestamp(day, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")])
    return items.select(F.coalesce("guid", "link").alias("external_id"), F.col("link").alias("url"), F.trim("title").alias("title"), when.alias("published_at"), F.col("description").alias("text"))


def upsert(stored: DataFrame, arrived: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Keep-latest by natural key: stored and arrived rows, the greatest version of each key; an arrived row wins a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(arrived.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return R.latest_by(both, keys, [F.col(version).desc_nulls_last(), F.col("_new").desc()]).drop("_new")


def unseen(arrived: DataFrame, stored: DataFrame, content: str, digest: str = "content_hash") -> DataFrame:
    """Arrived rows whose content no stored row has, each content once, with its SHA-256."""
    hashed = arrived.withColumn(digest, F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates([digest])
    return hashed.join(stored.select(digest), digest, "left_anti")


def sync_plan(stored: DataFrame, arrived: DataFrame, key: str, least_share: float = 0.9) -> DataFrame:
    """What replacing the whole table would do: (key, action add, keep or remove, safe).

    safe is false on every row where fewer than least_share of the stored keys arrived: nothing may then be removed.
    """
    old, new = stored.select(key).distinct().withColumn("_o", F.lit(True)), arrived.select(key).distinct().withColumn("_n", F.lit(True))
    plan = old.join(new, key, "full")
    action = F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "remove").otherwise("keep")
    plan = plan.select(key, action.alias("action"))
    counts = plan.agg(F.count_if(F.col("action") == "keep").alias("_kept"), F.count_if(F.col("action") != "add").alias("_stored"))
    safe = F.col("_kept") >= F.col("_stored") * F.lit(least_share)
    return plan.crossJoin(F.broadcast(counts.select(safe.alias("safe"))))  # one row


def admission(docs: DataFrame, text: str, published: str, first: str, last: str) -> DataFrame:
    """docs with skip_reason: no_text, unknown_date or out_of_range; null where the document is admitted."""
    day = F.to_date(published)
    reason = (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "no_text")
        .when(day.isNull(), "unknown_date")
        .when(~day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), "out_of_range")
    )
    return docs.withColumn("skip_reason", reason)


def tombstones(docs: DataFrame, expired: Column, content: str, kind: str = "content_type") -> DataFrame:
    """Expired rows keep their key and lose their bytes."""
    return docs.withColumn(kind, F.when(expired, "expired").otherwise(F.col(kind))).withColumn(content, F.when(expired, F.lit("").cast("binary")).otherwise(F.col(content)))


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Rebuild sink: only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
