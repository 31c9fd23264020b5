"""Star, semi, anti, lateral, band, window, as-of and set-operation shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import joins as J
from factloom.operators import relational as R
from factloom.plans.base import query, table


@query("""
select n_name, r_name, count(*) as orders, round(sum(o_totalprice), 2) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where o_orderdate between timestamp '1996-01-01' and timestamp '1997-12-31' group by all""")
def star_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter(F.col("o_orderdate").between("1996-01-01", "1997-12-31")).select("o_custkey", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select doc_id, n_chars from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
def semi_with_event(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that no run has read yet."""
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""
select d.doc_id, coalesce(l.toxic, -1) as toxic, case when coalesce(l.quality, 1) <> 0 then true else false end as shown
from documents d left join labels l on l.doc_id = d.doc_id""")
def left_join_with_default(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), (F.coalesce("quality", F.lit(1)) != 0).alias("shown"))


@query("""
select o_orderkey, l.l_partkey, l.l_quantity from orders left join lateral (
    select l_partkey, l_quantity from lineitem where l_orderkey = o_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey limit 1) l on true""")
def lateral_first_charge(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's first line, by a ranking of the lines once (a lateral top-1)."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_suppkey")
    first = R.latest_by(lines, ["l_orderkey"], [F.col("l_quantity").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_partkey", "l_quantity")


@query("""
with copies as (select md5(text) as m, doc_id from documents), firsts as (select m, min(doc_id) as x from copies group by m)
select x, doc_id as y from copies join firsts using (m) where x < doc_id""")
def equal_name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs x < y of equal content, x the first of its class: the copies of a class are tied, not paired with each other."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("y"), F.md5("text").alias("m"))
    firsts = docs.groupBy("m").agg(F.min("y").alias("x"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return docs.join(firsts, "m").filter("x < y").select("x", "y")


@query("""
select c_custkey, s_suppkey, c_nationkey from customer join supplier on s_nationkey = c_nationkey
where s_acctbal between c_acctbal - 250 and c_acctbal + 250""")
def banded_age_join(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), "s_acctbal")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") - 250).alias("low"), (F.col("c_acctbal") + 250).alias("high"))
    return J.band_join(suppliers, customers, ["c_nationkey"], "s_acctbal", "low", "high", 500.0).select("c_custkey", "s_suppkey", "c_nationkey")


@query("""
select a.event_id as left_event, b.event_id as right_event, a.user_id
from events a join events b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type = 'purchase'
 and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 10800000000""")
def interval_window_join(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and purchases of one user at most three hours apart."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf, "events")
    errors = events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("left_event"), at.alias("a"))
    buys = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("right_event"), at.alias("b"))
    return J.interval_join(errors, buys, ["user_id"], "a", "b", 10_800_000_000).select("left_event", "right_event", "user_id")


@query("""
select e.event_id, e.user_id, e.ts, p.value as last_price from (select * from events where event_type = 'purchase') e
asof left join (select user_id, ts, max(value) as value from events where event_type = 'view' group by all) p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_last_view(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the value of its user's latest view until then."""
    events = table(spark, sf, "events")
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("last_price"))
    return J.as_of_join(buys, views, ["user_id"], "ts", "seen", ["last_price"])


@query("""
with s as (select user_id, event_id, epoch(ts)::bigint as t, event_type from events),
pairs as (
    select a.user_id, a.event_id as id, b.event_id as r_id, greatest(0, b.t - (a.t + 60), a.t - (b.t + 60)) as gap
    from s a join s b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'purchase')
select user_id, id, r_id, gap from (select *, min(gap) over (partition by user_id, id) as least from pairs where gap <= 20000) where gap = least""")
def nearest_span_within(spark: SparkSession, sf: str) -> DataFrame:
    """The purchases nearest to each sign-up, as spans of a minute, at most 20,000 s away; ties stay."""
    t = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    events = table(spark, sf, "events").withColumn("t", t)
    ups = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("start"), (F.col("t") + 60).alias("end"))
    buys = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("r_id"), F.col("t").alias("r_start"), (F.col("t") + 60).alias("r_end"))
    return J.nearest_span(ups, buys, ["user_id"], 20000).select("user_id", "id", "r_id", "gap")


@query("""
with one as (select c_nationkey, c_mktsegment, min(c_custkey) as c_custkey from customer where c_acctbal > 8500 group by all having count(*) = 1)
select s_suppkey, s_nationkey, o.c_custkey from supplier left join one o on o.c_nationkey = s_nationkey and o.c_mktsegment = 'BUILDING'""")
def unique_match_attach(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier gets the customer of its nation where there is but one."""
    customers = table(spark, sf, "customer").filter("c_acctbal > 8500 and c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("s_nationkey"), "c_custkey")
    return R.unique_match_join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), customers, ["s_nationkey"]).select("s_suppkey", "s_nationkey", "c_custkey")


@query("""
with asked as (select user_id * 3 as doc_id, event_id as ordinal, (event_id % 50)::int as start from events where event_type = 'click' and value > 120)
select ordinal, a.doc_id, substr(text, start + 1, 40) as piece from asked a left join documents d on d.doc_id = a.doc_id""")
def text_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of texts that requests name, null where the text is gone."""
    asked = table(spark, sf, "events").filter("event_type = 'click' and value > 120").select(
        (F.col("user_id") * 3).alias("doc_id"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 50).cast("int").alias("start")
    )
    joined = asked.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "left")
    return joined.select("ordinal", "doc_id", F.substring(F.col("text"), F.col("start") + 1, F.lit(40)).alias("piece"))


@query("""
select a.p_name, b.p_name as other, 2::bigint as common from (select distinct p_name from part) a join (select distinct p_name from part) b
on len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) = 2 where len(list_distinct(string_split(a.p_name, ' '))) = 2""")
def names_with_equal_words(spark: SparkSession, sf: str) -> DataFrame:
    """Names whose words are those of another one, in any order, over an inverted index."""
    names = table(spark, sf, "part").select("p_name").distinct().withColumn("w", F.array_distinct(X.words(F.col("p_name")))).filter(F.size("w") == 2)
    other = names.select(F.col("p_name").alias("other"), F.col("w").alias("w2"))
    return J.word_subset_join(names, other, "w", "w2", "p_name", "other")


@query("""
with tiers as (
    select 0 as tier, o_custkey as k, o_orderkey as v from orders where o_orderstatus = 'F' union all
    select 1, o_custkey, o_orderkey from orders where o_orderstatus = 'O' union all
    select 2, o_custkey, o_orderkey from orders where o_orderstatus = 'P')
select k, v, tier from (select *, row_number() over (partition by k order by tier, v) as r from tiers) where r = 1""")
def fallback_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """A weaker source counts only where the stronger ones have nothing."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    tiers = [orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O", "P")]
    return J.first_tier(tiers, "k", [F.col("v")])


@query("""
with marks as (select doc_id, case when toxic = 1 then 'victim' end as v from labels),
titles as (select doc_id, case when starts_with(text, 'The ') then 'official' end as v from documents)
select d.doc_id, coalesce(m.v, t.v, 'mentioned') as role, case when m.v is not null then 'mark' when t.v is not null then 'title' else 'base' end as told_by
from documents d left join marks m on m.doc_id = d.doc_id left join titles t on t.doc_id = d.doc_id""")
def role_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """A mark counts before a title, and a title before the default."""
    docs = table(spark, sf, "documents")
    marks = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "victim").alias("role"))
    titles = docs.select("doc_id", F.when(F.startswith("text", F.lit("The ")), "official").alias("role"))
    base = docs.select("doc_id", F.lit("mentioned").alias("role"))
    return R.priority_overlay(base, "doc_id", "role", [("mark", marks), ("title", titles)], "told_by")


@query("""
select event_id, greatest(10, least(90, (event_id % 100)::int)) as score, (props->>'$.k')::bigint as k from events where (props->>'$.k')::bigint in (1, 5, 7, 69)""")
def json_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    score = F.greatest(F.lit(10), F.least(F.lit(90), (F.col("event_id") % 100).cast("int")))
    return table(spark, sf, "events").filter(k.isin(1, 5, 7, 69)).select("event_id", score.alias("score"), k.alias("k"))


@query("""
select user_id from events where event_type = 'purchase' and value > 300 union select o_custkey from orders where o_totalprice > 480000""")
def affected_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    buyers = table(spark, sf, "events").filter("event_type = 'purchase' and value > 300").select("user_id")
    return buyers.union(table(spark, sf, "orders").filter("o_totalprice > 480000").select("o_custkey")).distinct()


@query("""
select o_custkey, o_orderdate from (
    select o_custkey, o_orderdate from orders where o_totalprice > 495000 union all select null, max(o_orderdate) from orders)""")
def union_with_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    """The latest date comes along even where nothing else does."""
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderdate").alias("o_orderdate")).select(F.lit(None).cast("long").alias("o_custkey"), "o_orderdate")
    return orders.filter("o_totalprice > 495000").select("o_custkey", "o_orderdate").unionByName(last)


@query("""
select c_custkey, datediff('year', b, d) - (strftime(d, '%m%d') < strftime(b, '%m%d'))::int as age
from (select c_custkey, date '1950-01-01' + (c_custkey * 7 % 20000)::int as b, date '2023-02-28' as d from customer)""")
def age_on_date(spark: SparkSession, sf: str) -> DataFrame:
    birth = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 7 % 20000).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", X.age_at(birth, F.lit("2023-02-28").cast("date")).cast("long").alias("age"))


@query("""
with days as (select user_id, ts::date as day, sum(value) as total from events group by all)
select user_id, day, round(total, 6) as total, round(lag(total) over (partition by user_id order by day), 6) as before from days""")
def previous_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("t"))
    before = F.lag("t").over(Window.partitionBy("user_id").orderBy("day"))
    return days.select("user_id", "day", F.round("t", 6).alias("total"), F.round(before, 6).alias("before"))
