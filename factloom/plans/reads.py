"""Read shapes of the catalogue: cards, spans, queues, statistics of the newest run, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.plans.base import query, table


@query("""
select d.doc_id, d.source, d.lang, d.n_chars, l.quality from documents d join (select distinct user_id as doc_id from events where value > 100) a using (doc_id) left join labels l using (doc_id)""")
def article_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of the ids asked for; an id that isn't stored is left out, and the text isn't read."""
    asked = table(spark, sf, "events").filter("value > 100").select(F.col("user_id").alias("doc_id"))
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(asked, "doc_id", "left_semi")
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("select doc_id, length(text)::bigint as characters from documents where doc_id in (select user_id from events where event_type = 'click')")
def text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "events").filter("event_type = 'click'").select(F.col("user_id").alias("doc_id"))
    return table(spark, sf, "documents").join(asked, "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("characters"))


@query("select min(o_orderdate) as first_day, max(o_orderdate) as last_day, count(*) as orders from orders where o_orderstatus <> 'P'")
def published_span(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'").agg(F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"), F.count("*").alias("orders"))


@query("select o_orderkey, o_orderdate from orders where o_orderdate::date in (select l_shipdate::date from lineitem where l_quantity = 50 and l_discount = 0.09)")
def published_on_days(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the days that another table names."""
    days = table(spark, sf, "lineitem").filter("l_quantity = 50 and l_discount = 0.09").select(F.to_date("l_shipdate").alias("day")).distinct()
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day")).join(days, "day", "left_semi").drop("day")


@query("select source, doc_id from documents where (lang, n_chars) in (select lang, max(n_chars) from documents group by lang)")
def longest_of_each_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    longest = docs.groupBy("lang").agg(F.max("n_chars").alias("n_chars"))
    return docs.join(longest, ["lang", "n_chars"], "left_semi").select("source", "doc_id")


@query("""
with newest as (select l_orderkey, max(l_shipdate) as last from lineitem group by l_orderkey)
select o_custkey, count(*) as lines, round(sum(l_quantity), 2) as quantity from lineitem l join newest n on n.l_orderkey = l.l_orderkey and n.last = l.l_shipdate join orders on o_orderkey = l.l_orderkey group by o_custkey""")
def statistics_of_newest_run(spark: SparkSession, sf: str) -> DataFrame:
    """Only the lines of each order's newest run count, for their customer."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    last = F.max("l_shipdate").over(Window.partitionBy("l_orderkey"))
    newest = lines.withColumn("last", last).filter("l_shipdate = last")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return newest.join(orders, "l_orderkey").groupBy("o_custkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
with p as (select distinct l_orderkey, l_partkey from lineitem where l_quantity > 48)
select a.l_partkey as part, b.l_partkey as other, count(*) as orders from p a join p b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by all""")
def named_together(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that occur in one order (a bounded group), and how often."""
    parts = table(spark, sf, "lineitem").filter("l_quantity > 48").select("l_orderkey", F.col("l_partkey").alias("part")).distinct()
    return parts.join(parts.withColumnRenamed("part", "other"), "l_orderkey").filter("part < other").groupBy("part", "other").agg(F.count("*").alias("orders"))


@query("""
select role, count(*) as turns, count(distinct conv_id) as conversations, round(avg(length(text)), 4) as mean_length from conversations group by role""")
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("mean_length")
    )


@query("""
select u.user_id, coalesce(e.errors, 0) as errors, coalesce(o.orders, 0) as orders, greatest(e.last, o.last) as last
from (select distinct user_id from events) u left join (select user_id, count(*) as errors, max(ts) as last from events where event_type = 'error' group by 1) e on e.user_id = u.user_id
left join (select o_custkey, count(*) as orders, max(o_orderdate) as last from orders group by 1) o on o.o_custkey = u.user_id""")
def dossier_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What the tables tell of each user: aggregates first, joined on the user."""
    events = table(spark, sf, "events")
    errors = events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"), F.max("ts").alias("last_error"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last_order"))
    joined = events.select("user_id").distinct().join(errors, "user_id", "left").join(orders, "user_id", "left")
    zero = F.lit(0)
    return joined.select("user_id", F.coalesce("errors", zero).alias("errors"), F.coalesce("orders", zero).alias("orders"), F.greatest("last_error", "last_order").alias("last"))
