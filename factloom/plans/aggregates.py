"""Counts, collections, modes, histograms, percentiles and grouped statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.plans.base import query, table


@query("select source, lang, count(*) as n, count(distinct text) as texts, min(n_chars) as shortest, max(n_chars) as longest from documents group by all")
def counts_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "documents").groupBy("source", "lang")
        .agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
    )


@query("""
select p_brand, string_agg(distinct p_type, ';' order by p_type) as types, list_sort(list(distinct p_size)) as sizes from part group by p_brand""")
def sorted_distinct_collections(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("t"), F.sort_array(F.collect_set("p_size")).alias("sizes"))
    return part.select("p_brand", F.array_join("t", ";").alias("types"), "sizes")


@query("""
select user_id, event_type, n from (
    select *, row_number() over (partition by user_id order by n desc, event_type) as r from (
        select user_id, event_type, count(*) as n from events group by all)) where r = 1""")
def modal_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return R.mode_by(table(spark, sf, "events"), ["user_id"], "event_type")


@query("""
select user_id, string_agg(event_type || '=' || n, ',' order by n desc, event_type) as variants
from (select user_id, event_type, count(*) as n from events group by all) group by user_id""")
def variant_histogram(spark: SparkSession, sf: str) -> DataFrame:
    found = R.histogram(table(spark, sf, "events"), ["user_id"], "event_type")
    return found.withColumn("variants", F.array_join(F.transform("variants", lambda v: F.concat_ws("=", v["value"], v["n"])), ","))


@query("""
select o_custkey, string_agg(o_orderpriority || '=' || n, ',' order by o_orderpriority) as counts
from (select o_custkey, o_orderpriority, count(*) as n from orders group by all) group by o_custkey""")
def merged_count_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's one-entry map of counts, merged by customer."""
    maps = table(spark, sf, "orders").select("o_custkey", F.create_map("o_orderpriority", F.lit(1).cast("long")).alias("counts"))
    merged = R.sum_maps(maps, ["o_custkey"], "counts")
    entries = F.transform(F.sort_array(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select("o_custkey", F.array_join(entries, ",").alias("counts"))


@query("select o_custkey, count(*) as orders, max(o_totalprice) as most from orders group by o_custkey having count(*) > 12")
def having_many(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("most"))
    return orders.filter("orders > 12")


@query("""
select case when o_totalprice < 50000 then 'small' when o_totalprice < 200000 then 'middle' else 'large' end as bucket, o_orderstatus, count(*) as n
from orders group by all""")
def case_bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.when(F.col("o_totalprice") < 50000, "small").when(F.col("o_totalprice") < 200000, "middle").otherwise("large")
    return table(spark, sf, "orders").groupBy(bucket.alias("bucket"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("""
select (select count(*) from documents) as documents, (select count(distinct source) from documents) as sources,
       (select count(*) from labels where toxic = 1) as toxic, (select count(distinct user_id) from events) as users,
       (select count(*) from orders where o_orderstatus = 'F') as finished""")
def dashboard_row(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counts, one pass over each table."""
    parts = [
        table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources")),
        table(spark, sf, "labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic")),
        table(spark, sf, "events").agg(F.count_distinct("user_id").alias("users")),
        table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query("""
with seen as (select user_id, max((event_type = 'view')::int) as v, max((event_type = 'click')::int) as c, max((event_type = 'purchase')::int) as p from events where value > 60 group by user_id)
select 1 as step, 'view' as stage, count(*) filter (where v = 1) as users from seen union all
select 2, 'click', count(*) filter (where v = 1 and c = 1) from seen union all
select 3, 'purchase', count(*) filter (where v = 1 and c = 1 and p = 1) from seen""")
def funnel_counts(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda kind: F.max((F.col("event_type") == kind).cast("int")).alias(kind)
    seen = table(spark, sf, "events").filter("value > 60").groupBy("user_id").agg(has("view"), has("click"), has("purchase"))
    one = seen.agg(
        F.count_if(F.col("view") == 1).alias("a"),
        F.count_if((F.col("view") == 1) & (F.col("click") == 1)).alias("b"),
        F.count_if((F.col("view") == 1) & (F.col("click") == 1) & (F.col("purchase") == 1)).alias("c"),
    )
    return one.selectExpr("stack(3, 1, 'view', a, 2, 'click', b, 3, 'purchase', c) as (step, stage, users)")


@query("""
select p_brand as brand, count(*) as cases, count(m) as imprisoned, round(avg(m) / 12, 1) as mean_years, round(median(m) / 12, 1) as median_years, round(max(m) / 12.0, 1) as max_years
from (select p_brand, case when l_quantity::int - 10 > 0 then l_quantity::int - 10 end as m from lineitem join part on l_partkey = p_partkey) group by p_brand having count(*) >= 5""")
def group_stats_mean_median_max(spark: SparkSession, sf: str) -> DataFrame:
    """Cases, those with a term, and mean, median and longest term in years, of keys with five cases or more."""
    lines = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_quantity").cast("int") - 10).alias("months"))
    rows = lines.join(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
    return R.group_statistics(rows, "brand", "months", 5)[0]


@query("""
with keys as (select l_orderkey, unnest(list_distinct([l_returnflag, l_linestatus])) as k, l_quantity from lineitem)
select k as article, count(*) as cases, round(avg(l_quantity), 6) as mean from keys group by k""")
def explode_multikey_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A case counts under each of its keys, once."""
    keys = F.explode(F.array_distinct(F.array("l_returnflag", "l_linestatus"))).alias("article")
    return table(spark, sf, "lineitem").select(keys, "l_quantity").groupBy("article").agg(F.count("*").alias("cases"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("""
with s as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, min(value) filter (where r >= ceil(n * 0.5)) as p50, min(value) filter (where r * 100 >= n * 95) as p95, min(value) filter (where r * 100 >= n * 99) as p99 from s group by event_type""")
def nearest_rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return R.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", [50, 95, 99])


@query("""
with stamps as (select user_id as key, ts as stamp from events union all select o_custkey, o_orderdate from orders)
select key, max(stamp) as changed, max(stamp) + interval 7 day as settled from stamps group by key""")
def union_change_stamps_settle(spark: SparkSession, sf: str) -> DataFrame:
    """The last change of each key over several tables, and when it has settled."""
    stamps = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("stamp")).unionByName(
        table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("stamp"))
    )
    return stamps.groupBy("key").agg(F.max("stamp").alias("changed")).withColumn("settled", F.col("changed") + F.expr("interval 7 days"))


@query("""
select c_custkey, count(o_orderkey) as orders, max(o_totalprice) as most from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def counts_with_zeroes(spark: SparkSession, sf: str) -> DataFrame:
    """Counts first, then a left join that keeps who has none."""
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("most"))
    joined = table(spark, sf, "customer").select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "most")


@query("""
select p_partkey, min(l_shipdate) as first_seen, max(l_shipdate) as last_seen from part left join lineitem on l_partkey = p_partkey group by p_partkey""")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    return table(spark, sf, "part").select("p_partkey").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey")


@query("""
select user_id, min(s) as s, max(e) as e, count(*) as merged from (
    select *, sum(fresh) over (partition by user_id order by s, e rows unbounded preceding) as island from (
        select *, case when s > max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from (
            select user_id, epoch(ts)::bigint - 1800 as s, epoch(ts)::bigint + 1800 as e from events)))
group by user_id, island""")
def merged_evidence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of half an hour around each event, merged where they overlap."""
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    windows = table(spark, sf, "events").select("user_id", (at - 1800).alias("s"), (at + 1800).alias("e"))
    return R.merge_intervals(windows, ["user_id"], "s", "e")
