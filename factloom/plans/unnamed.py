"""Unnamed persons over derived tables: suppliers as descriptions, customers as list entries, orders as reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.operators import unnamed
from factloom.plans.base import query, table


@query("""
with e as (select c_custkey as entry, date '1950-01-01' + (c_custkey * 7 % 20000)::int as birth, c_nationkey as k, c_mktsegment as birth_place from customer),
u as (select s_suppkey as id, (20 + s_suppkey % 50)::int as age, date '2020-06-15' + s_suppkey::int as d, s_nationkey as k, 'BUILD' as place from supplier),
met as (select u.id, e.entry, datediff('year', birth, d) - (strftime(d, '%m%d') < strftime(birth, '%m%d'))::int as exact_age, contains(lower(birth_place), lower(place)) as in_place, age
        from u join e on e.k = u.k),
kept as (select *, count(*) over (partition by id) as found from met where exact_age between age and age + 1)
select id, rank::int as rank, entry, exact_age::int as exact_age, in_place, found from (
    select *, row_number() over (partition by id order by in_place desc, exact_age = age desc, entry) as rank from kept) where rank <= 10""")
def unnamed_list_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the age (or a year older) and nation of each description."""
    birth = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 7 % 20000).cast("int"))
    entries = table(spark, sf, "customer").select(F.col("c_custkey").alias("entry"), birth.alias("birth"), F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("birth_place"))
    asked = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), (20 + F.col("s_suppkey") % 50).cast("int").alias("age"), F.date_add(F.lit("2020-06-15").cast("date"), F.col("s_suppkey").cast("int")).alias("on"),
        F.col("s_nationkey").alias("k"), F.lit("BUILD").alias("place"),
    )
    return unnamed.list_candidates(asked, entries, ["k"])


_ROWS = """
r as (select o_orderkey as id, o_custkey as person, o_orderpriority as region, case when o_totalprice > 100000 then (o_totalprice / 2000)::int end as term,
             case when o_totalprice > 450000 then '' else strftime(o_orderdate, '%Y-%m') end as d, o_orderstatus = 'P' as unnamed from orders),
s as (select *, case when term is not null then region || '|' || term end as place, case when term is not null and length(d) >= 7 then region || '|' || term || '|' || d end as sign from r),
named as (select id, min(id) over (partition by person, region) as c, place, sign from s where not unnamed),
of_sign as (select sign, min(c) as only_, count(distinct c) as n from named where sign is not null group by sign),
dated as (select u.id, u.place, case when o.n = 1 then o.only_ else min(u.id) over (partition by u.sign) end as c from s u left join of_sign o on o.sign = u.sign where u.unnamed and u.sign is not null),
known as (select place, min(c) as only_, count(distinct c) as n from (select place, c from named union all select place, c from dated) where place is not null group by place)"""


@query(f"""
with {_ROWS}
select id, c as "case" from dated union all
select u.id, case when k.n = 1 then k.only_ else u.id end from s u left join known k on k.place = u.place where u.unnamed and u.sign is null""")
def unnamed_rows_to_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Reports without a person joined to the one case that their signature, or their place, points at."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("region"),
        F.when(F.col("o_totalprice") > 100000, F.rint(F.col("o_totalprice") / 2000).cast("int")).alias("term"),
        F.when(F.col("o_totalprice") > 450000, "").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("on"), F.lit(7).alias("exact"), "o_orderstatus",
    )
    named = rows.filter("o_orderstatus <> 'P'")
    firsts = named.groupBy("person", "region").agg(F.min("id").alias("case"))
    cases = named.join(firsts, ["person", "region"]).select("id", "case", "region", "term", "on", "exact")
    return unnamed.attach_unnamed(rows.filter("o_orderstatus = 'P'").select("id", "region", "term", "on", "exact"), cases)


@query("""
with listing as (select distinct on (event_type, user_id) event_type as source, (value / 20)::int as page, user_id as item from events order by event_type, user_id, value, event_id),
known as (select distinct user_id as item from events where value > 250),
stops as (select source, min(page) as stop from (select source, page from listing l left join known k on k.item = l.item group by source, page having count(k.item) = count(*)) group by source)
select l.source, l.page, l.item from listing l left join stops s on s.source = l.source left join known k on k.item = l.item where k.item is null and (s.stop is null or l.page < s.stop)""")
def discover_until_known(spark: SparkSession, sf: str) -> DataFrame:
    """New items on the pages before the first page that is known whole."""
    events = table(spark, sf, "events")
    once = R.latest_by(events, ["event_type", "user_id"], [F.col("value"), F.col("event_id")])
    listing = once.select(F.col("event_type").alias("source"), F.rint(F.col("value") / 20).cast("int").alias("page"), F.col("user_id").alias("item"))
    return unnamed.until_known(listing, events.filter("value > 250").select(F.col("user_id").alias("item")), "source", "page", "item")


@query("""
with n as (select p_brand, string_split(p_name, ' ') as courts, p_size from part), u as (select p_size, unnest(list_distinct(courts)) as court from n), c as (select p_size, court, count(*) as n from u group by all)
select p_partkey as id, rank::int as rank, court, n from (
    select p_partkey, court, n, row_number() over (partition by p_partkey order by n desc, court) as rank from part join c using (p_size)) where rank <= 3""")
def court_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The words most frequent in names of equal size, as hints of a court."""
    part = table(spark, sf, "part")
    sentences = part.select("p_size", F.split("p_name", " ").alias("courts"))
    return unnamed.court_hints(part.select(F.col("p_partkey").alias("id"), "p_size"), sentences, ["p_size"])
