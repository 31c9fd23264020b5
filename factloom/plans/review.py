"""Holds, junk, reviews, precedence, the known base, groups and their support, and facts read from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import listmatch, review
from factloom.plans import matching as M
from factloom.plans.base import query, table

_ACTIONS = ("hold", "mark_junk", "release", "unrelease")


@query("""
with recursive a as (select user_id, row_number() over (partition by user_id order by event_id) as n, ['hold', 'mark_junk', 'release', 'unrelease'][1 + (value * 100)::bigint % 4] as a from events where event_type <> 'view'),
s as (select user_id, 0::bigint as n, 'none' as state from a group by user_id
      union all select s.user_id, a.n, case when state = 'none' and a.a = 'hold' then 'held' when state = 'held' and a.a = 'mark_junk' then 'junk' when state = 'held' and a.a = 'release' then 'released'
                                            when state = 'released' and a.a = 'unrelease' then 'junk' else state end from s join a on a.user_id = s.user_id and a.n = s.n + 1)
select user_id, arg_max(state, n) as state from s group by user_id""")
def hold_life_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """What a sequence of actions leaves of each hold."""
    action = F.get(F.array(*[F.lit(a) for a in _ACTIONS]), (F.rint(F.col("value") * 100).cast("long") % 4).cast("int"))
    rows = table(spark, sf, "events").filter("event_type <> 'view'").select("user_id", "event_id", action.alias("action"))
    return review.hold_states(rows, "user_id", ["event_id"], "action")


@query("""
with runs as (select o_orderkey as run, o_custkey as article from orders where o_orderstatus <> 'P'),
latest as (select article, max(run) as run from runs group by article)
select article from latest where run not in (select l_orderkey from lineitem where l_returnflag = 'R') and article not in (select c_custkey from customer where c_acctbal < 0)""")
def junk_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose latest run that succeeded found no charge, but for those that are held."""
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("article"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"))
    events = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("type"))
    holds = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("article"), F.lit("held").alias("state"))
    return review.junk(runs, events, holds, ["R"])


_REVIEWS_SQL = """
with reviews as (select user_id as mention, event_id as n, event_type, (value * 100)::bigint % 1000 as p from events),
last_ as (select mention, arg_max({'t': event_type, 'p': p}, n) as r from reviews group by mention)"""


def _reviewed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    links = table(spark, sf, "customer").select(F.col("c_custkey").alias("mention"), F.col("c_nationkey").cast("long").alias("person"))
    kind, p = F.col("event_type"), F.rint(F.col("value") * 100).cast("long") % 1000
    action = F.when(kind == "click", "link").when(kind == "view", "create").when(kind == "error", "keep_separate").otherwise("reject")
    return review.apply_reviews(links, table(spark, sf, "events").select(F.col("user_id").alias("mention"), F.col("event_id").alias("at"), action.alias("action"), p.alias("person"), p.alias("distinct_from")))


@query(_REVIEWS_SQL + """
select c_custkey as mention, case when r is null then c_nationkey when r.t = 'click' then r.p when r.t in ('view', 'error') then -1 - c_custkey end::bigint as person, case when r is null then 'rule' else 'review' end as decided_by
from customer left join last_ on mention = c_custkey""")
def reviewed_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links after the last review of each mention."""
    return _reviewed(spark, sf)[0]


@query(_REVIEWS_SQL + " select distinct least(r.p, -1 - mention) as a, greatest(r.p, -1 - mention) as b from last_ where r.t = 'error'")
def distinct_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of persons that reviews keep apart."""
    return _reviewed(spark, sf)[1]


@query(f"""
with {M._NAMES_SQL}, {M._CLASSIFIED_SQL}
select c.doc_id, coalesce(case when list_contains(kinds, 'charge') then 'POLITICAL' end, case when quality = 0 then 'COMMON' end, case when len(kinds) >= 2 then 'POLITICAL' end, 'UNCLEAR') as verdict,
       case when list_contains(kinds, 'charge') then 'article' when quality = 0 then 'base' when len(kinds) >= 2 then 'rule' else 'none' end as method
from classified c left join labels l on l.doc_id = c.doc_id""")
def verdict_by_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """A charge's article first, then the base, then a rule; the rest is unclear."""
    judged = M.classified(spark, sf).select("doc_id", "kinds").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    verdict, method = review.first_known([
        ("article", F.when(F.array_contains("kinds", "charge"), "POLITICAL")), ("base", F.when(F.col("quality") == 0, "COMMON")),
        ("rule", F.when(F.size("kinds") >= 2, "POLITICAL")), ("none", F.lit("UNCLEAR")),
    ])
    return judged.select("doc_id", verdict.alias("verdict"), method.alias("method"))


@query(f"""
with {M._NAMES_SQL},
asked as (select doc_id as person, list_sort(list_distinct(case when doc_id % 3 = 0 then [given, surname] else [given, surname, patronymic] end)) as w from names),
base as (select doc_id as record, list_sort(list_distinct(case when doc_id % 2 = 0 then [given, surname] else [given, surname, patronymic] end)) as w from names where source <> 'src0'),
fits as (
    select a.person, len(a.w) as n, a.w = b.w as exact from asked a join base b on len(a.w) >= 2 and len(b.w) >= 2
    and (len(list_intersect(a.w, b.w)) = len(a.w) or len(list_intersect(a.w, b.w)) = len(b.w))),
counted as (select person, min(n) as n, count(*) filter (where exact) as exact, count(*) as records from fits group by person),
levelled as (select *, case when exact = 1 and (n >= 3 or records = 1) then 'in_base' when records = 1 then 'probably' else 'namesakes' end as level from counted)
select person, level, case when level = 'in_base' then 1 else records end as records from levelled""")
def known_base_levels(spark: SparkSession, sf: str) -> DataFrame:
    """What a base of names says of each document's subject."""
    every = M.subjects(spark, sf)
    words = lambda short: F.when(short, F.array("given", "surname")).otherwise(F.array("given", "surname", "patronymic"))
    asked = every.select(F.col("doc_id").alias("person"), words(F.col("doc_id") % 3 == 0).alias("words"))
    base = every.filter("source <> 'src0'").select(F.col("doc_id").alias("record"), words(F.col("doc_id") % 2 == 0).alias("words"))
    return review.base_levels(asked, base)


@query("""
with n as (select case when p_partkey % 5 = 0 then string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] else p_name end as name, count(*) as mentions from part group by 1),
k as (select *, array_to_string(list_sort(string_split(name, ' ')), ' ') as key from n where len(string_split(name, ' ')) = 2),
f as (select *, first_value(name) over (partition by key order by mentions desc, name) as into_ from k)
select name, into_ from f where name <> into_""")
def swapped_name_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Names of two words in the order that is mentioned less."""
    w = F.split("p_name", " ")
    names = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(0)))).otherwise(F.col("p_name")).alias("name"))
    return review.swapped_names(names.groupBy("name").agg(F.count("*").alias("mentions"))).withColumnRenamed("into", "into_")


@query("""
with c as (select case when o_orderkey % 7 = 0 then '' else o_orderpriority || left(o_orderstatus, 1) || o_custkey % 3 end as g, count(*) as n from orders group by 1),
big as (select 'supported' as part, g, n from c where g <> '' and n >= (select count(*) // 40 from orders)),
small as (select 'tail' as part, g, n from c where g <> '' and n < (select count(*) // 40 from orders) order by n desc, g limit 5)
select * from big union all select * from small union all select 'unknown', null, sum(n) from c where g = ''""")
def groups_with_support(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of enough cases, the five largest of the others, and the cases of no known group."""
    orders = table(spark, sf, "orders")
    name = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat("o_orderpriority", F.left("o_orderstatus", F.lit(1)), (F.col("o_custkey") % 3).cast("string")))
    big, small, unknown = review.supported_groups(orders.groupBy(name.alias("g")).agg(F.count("*").alias("n")), "g", "n", orders.count() // 40, 5)
    return big.withColumn("part", F.lit("supported")).unionByName(small.withColumn("part", F.lit("tail"))).unionByName(unknown.withColumn("part", F.lit("unknown")))


@query("select o_orderkey from orders where o_custkey is not null and o_custkey not in (select user_id from events where event_type = 'error' and user_id is not null)")
def orders_not_in(spark: SparkSession, sf: str) -> DataFrame:
    """NOT IN with nulls on the excluded side."""
    excluded = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", F.col("user_id")).alias("o_custkey"))
    return review.not_in(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), excluded, "o_custkey").select("o_orderkey")


@query("""
with hits as (select user_id as person, round(value / 500, 4) as score from events where event_type = 'purchase' union all select o_custkey, round(o_totalprice / 500000, 4) from orders)
select person, max(score) as score from hits group by person order by score desc, person limit 30""")
def best_hits_of_persons(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty persons with the best score in either list."""
    events = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("person"), F.round(F.col("value") / 500, 4).alias("score"))
    return review.best_hits([events, table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), F.round(F.col("o_totalprice") / 500000, 4).alias("score"))], "person", "score", 30)


@query("""
with e as (select l_partkey as person, l_orderkey * 10 + l_linenumber as event, case when l_returnflag = 'R' then null else l_shipdate end as happened, o_orderdate as published from lineitem join orders on o_orderkey = l_orderkey)
select person, event, happened from (select *, row_number() over (partition by person order by coalesce(happened, published)::date desc nulls last, event desc) as r from e) where r = 1""")
def latest_by_effective_day(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event by its own day, or else its publication's; a day that no text gives stays null."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("published"))
    happened = F.when(F.col("l_returnflag") != "R", F.col("l_shipdate"))
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("person"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event"), happened.alias("happened"), "l_orderkey").join(orders, "l_orderkey")
    return review.effective_latest(rows, "person", "event", "happened", "published").select("person", "event", "happened")


_JSON_SQL = """json_ as (select user_id, '[' || string_agg('{"form": "' || event_type || '", "at": ' || event_id || '}', ',' order by event_id) || ']' as forms from events where value > 100 group by user_id)"""


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter("value > 100")
    return rows.groupBy("user_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("form"), x["event_id"].alias("at")))).alias("forms"))


@query(f"with {_JSON_SQL} select user_id from json_ where regexp_matches(forms, '(?i)\"form\": *\"[^\"]*URCH')")
def json_array_holds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of which some object of a JSON array has a form like the one asked for."""
    rows = _forms(spark, sf).withColumn("v", F.from_json("forms", "array<struct<form:string,at:long>>"))
    return rows.filter(F.exists("v", lambda v: v["form"].ilike("%URCH%"))).select("user_id")


@query("""
select user_id, "at", form from (
    select user_id, event_id as "at", event_type as form, row_number() over (partition by user_id order by event_type, event_id desc) as r from events where value > 100) where r = 1""")
def first_of_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One element of each JSON array: the first form, the latest of it."""
    rows = review.json_rows(_forms(spark, sf), ["user_id"], "forms", "form:string,at:long")
    return review.latest_by(rows, ["user_id"], [F.col("form"), F.col("at").desc()]).select("user_id", "at", "form")


@query("""
with runs as (select user_id as source, event_id as run, case when event_type = 'view' then 1 else 0 end as parsed, 1 as fetched from events),
r as (select *, row_number() over (partition by source order by run desc) as n from runs), h as (select source, min(n) filter (where parsed > 0) as hit from r group by source),
o as (select r.source, round(sum(parsed) / sum(fetched), 6) as share, count(*) filter (where hit is null or n < hit) as silent from r join h on h.source = r.source group by r.source)
select *, share < 0.2 or silent >= 4 as changed from o""")
def changed_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose pages are parsed too rarely, or not at all in the latest runs."""
    runs = table(spark, sf, "events").select(F.col("user_id").alias("source"), "event_id", F.when(F.col("event_type") == "view", 1).otherwise(0).alias("parsed"), F.lit(1).alias("fetched"))
    out = review.layout_change(runs, "source", F.col("event_id").desc(), "parsed", "fetched", 0.2, 4)
    return out.withColumn("share", F.round("share", 6))


@query("""
select p_partkey, coalesce(case trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') when 'economy-brand-2' then 'basic' when 'small-brand-17' then 'mini' end,
                           trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-')) as kind from part""")
def canonical_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Names by their slug, and by the canonical one where a lookup knows it."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" / ", "p_type", "p_brand").alias("raw"))
    return review.canonical(parts, "raw", {"economy-brand-2": "basic", "small-brand-17": "mini"}, "kind").select("p_partkey", "kind")


@query(f"""
with {M._NAMES_SQL}, {M._MATCH_SQL}
select person, case when entry is null then case when status = 'INSUFFICIENT_DATA' then 'unknown' else 'not_found' end when status = 'MATCHED' and entry % 2 = 0 then 'confirmed' else 'probable' end as shown from matched""")
def list_membership(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown of each name and the list."""
    found = M.matches(spark, sf)
    shown = listmatch.membership(F.col("status") != "INSUFFICIENT_DATA", F.col("entry").isNotNull(), F.col("status") == "MATCHED", F.coalesce(F.col("entry") % 2 == 0, F.lit(False)))
    return found.select("person", shown.alias("shown"))


@query(M._SCORED_SQL + """
select s.name, s.person, length(n.given) > 1 and length(n.surname) > 1 and length(n.patronymic) > 1 and not conflict and m_surname = 'exact' and m_given = 'exact' and m_patronymic in ('exact', 'missing') as promoted
from scored s join incoming n on n.name = s.name""")
def alias_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose name becomes an alias of the person."""
    kept = review.may_be_alias(F.array("given", "surname", "patronymic"), F.col("m_surname"), F.col("m_given"), F.col("m_patronymic"), F.col("conflict"))
    return M._scored(spark, sf)[1].select("name", "person", kept.alias("promoted"))
