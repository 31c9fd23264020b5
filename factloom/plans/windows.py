"""Ranking, paging, streaks and as-of reads over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.plans.base import query, table


@query("""
select user_id, event_id, event_type, ts from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def latest_event_per_user(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return R.latest_by(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


@query("""
select distinct on (o_custkey, o_orderpriority) o_custkey, o_orderpriority, o_orderkey, o_totalprice
from (select *, case when o_orderstatus = 'P' then null else o_totalprice end as price from orders)
order by o_custkey, o_orderpriority, price desc nulls last, o_orderkey""")
def distinct_on_multikey_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    best = R.latest_by(orders, ["o_custkey", "o_orderpriority"], [price.desc_nulls_last(), F.col("o_orderkey")])
    return best.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("""
select doc_id, source, n_chars, count(*) over () as total from documents where lang = 'en' order by n_chars desc, doc_id limit 50 offset 100""")
def page_with_total_count(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", "source", "n_chars")
    return R.page_with_total(docs, [F.col("n_chars").desc(), F.col("doc_id")], 100, 50)


@query("""
select source, doc_id, n_chars, r::int as rank from (
    select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) where r <= 5""")
def topk_docs_per_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return R.top_k_per_group(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 5)


@query("""
with firsts as (
    select *, row_number() over (partition by user_id, ts::date order by ts, event_id) as r from events),
latest as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from firsts where r = 1)
select user_id, event_id, ts, k::int as rank from latest where k <= 3""")
def first_mention_then_latest_publications(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each (user, day), then each user's three latest days."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts").withColumn("day", F.to_date("ts"))
    firsts = R.latest_by(events, ["user_id", "day"], [F.col("ts"), F.col("event_id")]).drop("day")
    return R.top_k_per_group(firsts, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3)


@query("""
with runs as (select o_custkey, o_orderkey, o_orderdate, o_orderpriority,
                     lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders)
select o_custkey, o_orderkey, o_orderdate, o_orderpriority from runs where before is null or before <> o_orderpriority""")
def changed_since_earlier_run(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose mark differs from that of the nearest earlier run of the same key."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    before = F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("o_orderpriority"))).drop("before")


@query("""
with days as (select event_type, ts::date as day, count(*) filter (where value > 200) as n from events group by all),
broken as (select *, sum(case when n < 25 then 0 else 1 end) over (partition by event_type order by day desc rows unbounded preceding) as b from days)
select event_type, count(*) filter (where b = 0) as streak from broken group by event_type""")
def leading_quiet_streak(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each type's latest days were quiet before one was not (layout-change detector)."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    days = events.groupBy("event_type", "day").agg(F.count_if(F.col("value") > 200).alias("n"))
    return R.leading_run(days, ["event_type"], [F.col("day").desc()], F.col("n") < 25)


@query("""
select o_custkey, o_orderkey, o_totalprice, max(o_totalprice) over (partition by o_custkey) as most,
       o_totalprice - lead(o_totalprice) over (partition by o_custkey order by o_totalprice desc, o_orderkey) as margin
from orders""")
def margin_to_next(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    following = F.lead("o_totalprice").over(by.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.max("o_totalprice").over(by).alias("most"), (F.col("o_totalprice") - following).alias("margin")
    )


@query("""
with ranked as (
    select c_custkey, c_nationkey, c_mktsegment, c_acctbal,
           row_number() over (partition by c_nationkey, c_mktsegment = 'BUILDING' order by c_acctbal desc, c_custkey) as r,
           c_mktsegment = 'BUILDING' as special from customer)
select c_nationkey, c_custkey, c_mktsegment, c_acctbal from ranked where (not special and r <= 3) or (special and r = 1)""")
def last_seat_in_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Three best of each nation, and a last seat for the best of one segment."""
    customers = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal")
    best = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    special = F.col("c_mktsegment") == "BUILDING"
    seats = R.top_k_per_group(customers.filter(~special), ["c_nationkey"], best, 3).unionByName(R.top_k_per_group(customers.filter(special), ["c_nationkey"], best, 1))
    return seats.drop("rank")


@query("""
with keep as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
                     row_number() over (partition by l_partkey, l_suppkey order by l_returnflag = 'R' desc, l_orderkey, l_linenumber) as r from lineitem)
select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag from keep where r = 1""")
def keep_best_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """All but the best row of each key go: level first, then age."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return R.latest_by(lines, ["l_partkey", "l_suppkey"], [(F.col("l_returnflag") == "R").desc(), F.col("l_orderkey"), F.col("l_linenumber")])


@query("""
select event_id, user_id, ts, value, last_value(case when event_type = 'purchase' then value end ignore nulls)
       over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as carried
from events""")
def carry_forward_last_known(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value", F.last(known, ignorenulls=True).over(w).alias("carried"))


@query("""
select user_id, min(ts) as start, max(ts) as last, count(*) as events from (
    select user_id, ts, event_id, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (
        select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hour then 1 else 0 end as fresh from events))
group by user_id, s""")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end after six quiet hours."""
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"), "ts")
    # a session_window ends its gap after the last event; a gap of exactly six hours goes on
    w = F.session_window("t", "21600 seconds 1 microsecond")
    return events.groupBy("user_id", w).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("events")).drop("session_window")


@query("""
select conv_id, turn, role, text, lag(role) over w as asked_by, lag(text) over w as question
from conversations window w as (partition by conv_id order by turn) qualify role = 'assistant'""")
def dialogue_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn with the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("asked_by"), F.lag("text").over(w).alias("question")).filter("role = 'assistant'")
