"""Candidates for unnamed persons, page filters, queues, purges, proven readings and registry cards over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import casework as C
from factloom.plans.base import query, table


def _text(c: str) -> F.Column:
    return F.col(c).cast("string")


@query("""
with u as (select s_suppkey as id, (20 + s_suppkey % 50)::int as age, date '2020-06-15' + s_suppkey::int as d, s_nationkey % 5 as place, case s_suppkey % 3 when 0 then 'f' when 1 then 'm' end as gender,
                  case when s_suppkey % 4 = 0 then 'B' else '' end as initial, [(s_suppkey % 7)::varchar, '105'] as articles, s_suppkey % 2 = 0 as sentence from supplier),
b as (select c_custkey as person, c_mktsegment || c_custkey as name, date '1950-01-01' + (c_custkey * 7 % 20000)::int as birth, c_nationkey % 5 as b_place, case when c_custkey % 2 = 0 then 'f' else 'm' end as b_gender,
             (c_custkey % 7)::varchar as article, case when c_custkey % 5 <> 0 then date '2020-05-01' + (c_custkey % 90)::int end as sentenced from customer),
met as (select *, datediff('year', birth, d) - (strftime(d, '%m%d') < strftime(birth, '%m%d'))::int as exact, place = b_place as placed, list_contains(articles, article) as article_match from u, b),
fits as (select *, not placed as by_sentence from met where exact between age and age + 1 and (gender is null or gender = b_gender) and starts_with(name, initial)
         and (placed or (sentence and article_match and sentenced between d - 60 and d + 3))),
known as (select f.*, coalesce(case c_custkey % 3 when 0 then 'same' when 1 then 'different' end, '') as decision from fits f left join customer on c_custkey = person and c_custkey % 10 = id),
ranked as (select *, row_number() over (partition by id order by decision = 'same' desc, decision = 'different', by_sentence, article_match desc, exact = age desc, name, person) as r from known),
seats as (select *, min(r) filter (where by_sentence) over (partition by id) as late from ranked)
select id, least(r, 3)::int as rank, person, by_sentence, article_match from seats where r < 3 or (r = 3 and (late is null or late <= 3)) or (late > 3 and r = late)""")
def unnamed_base_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Three records of a base for each description: by place, or by a sentence under one of its articles."""
    key = F.col("s_suppkey")
    asked = table(spark, sf, "supplier").select(
        key.alias("id"), (20 + key % 50).cast("int").alias("age"), F.date_add(F.lit("2020-06-15").cast("date"), key.cast("int")).alias("on"), (F.col("s_nationkey") % 5).alias("place"),
        F.when(key % 3 == 0, "f").when(key % 3 == 1, "m").alias("gender"), F.when(key % 4 == 0, "B").otherwise("").alias("initial"),
        F.array((key % 7).cast("string"), F.lit("105")).alias("articles"), (key % 2 == 0).alias("sentence"),
    )
    of = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    base = customers.select(
        of.alias("person"), F.concat("c_mktsegment", of.cast("string")).alias("name"), F.date_add(F.lit("1950-01-01").cast("date"), (of * 7 % 20000).cast("int")).alias("birth"),
        (F.col("c_nationkey") % 5).alias("b_place"), F.when(of % 2 == 0, "f").otherwise("m").alias("b_gender"), F.array((of % 7).cast("string")).alias("b_articles"),
        F.when(of % 5 != 0, F.date_add(F.lit("2020-05-01").cast("date"), (of % 90).cast("int"))).alias("sentenced"),
    )
    decisions = customers.select((of % 10).alias("id"), of.alias("person"), F.when(of % 3 == 0, "same").when(of % 3 == 1, "different").alias("decision"))
    return C.base_candidates(asked, base, decisions, 60, 3, 3)


@query("""
with u as (select s_suppkey as id, (20 + s_suppkey % 50)::int as age, date '2020-01-15' + s_suppkey::int as d, case s_suppkey % 3 when 0 then 'f' when 1 then 'm' end as gender from supplier),
b as (select date '1950-01-01' + (c_custkey * 7 % 20000)::int as birth, case c_custkey % 5 when 0 then null when 1 then 'f' when 2 then 'f' else 'm' end as b_gender from customer)
select id, (select count(*) from b where datediff('year', birth, d) - (strftime(d, '%m%d') < strftime(birth, '%m%d'))::int between age and age + 1 and (gender is null or b_gender is null or gender = b_gender)) as records from u""")
def unnamed_age_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many records of the base have the age and sex that a description tells."""
    key, of = F.col("s_suppkey"), F.col("c_custkey")
    asked = table(spark, sf, "supplier").select(
        key.alias("id"), (20 + key % 50).cast("int").alias("age"), F.date_add(F.lit("2020-01-15").cast("date"), key.cast("int")).alias("on"), F.when(key % 3 == 0, "f").when(key % 3 == 1, "m").alias("gender")
    )
    base = table(spark, sf, "customer").select(
        F.date_add(F.lit("1950-01-01").cast("date"), (of * 7 % 20000).cast("int")).alias("birth"), F.when(of % 5 == 0, None).when((of % 5).isin(1, 2), "f").otherwise("m").alias("b_gender")
    )
    return C.records_of_age(asked, base)


@query("""
with o as (select *, o_orderdate::date as d, (floor(o_totalprice)::bigint % 13)::varchar as charge, case when o_orderkey % 3 = 0 then 'f' when o_orderkey % 3 = 1 then 'm' end as gender from orders),
u as (select o_orderkey as id, d, o_orderpriority as place, case when o_orderkey % 2 = 0 then 'trial' end as stage, o_orderkey % 60 as age, gender, case when o_orderkey % 5 = 0 then 'o' else '' end as initial, charge from o where o_orderstatus = 'P'),
n as (select o_custkey as person, o_orderstatus || ' ' || o_custkey as name, o_orderkey as article, d as n_on, o_orderpriority as n_place, case when o_orderkey % 4 = 0 then 'trial' else 'search' end as n_stage, gender as n_gender, o_custkey % 60 as n_age, charge as n_charge from o where o_orderstatus <> 'P'),
met as (select *, age = n_age as age_match, charge = n_charge as article_match, initial <> '' and starts_with(lower(name), initial) as by_initial from u join n on place = n_place and abs(d - n_on) <= 20 where (stage is null or stage = n_stage) and (gender is null or n_gender is null or gender = n_gender)),
one as (select *, 2 * age_match::int + article_match::int as strength from met where age_match or article_match or by_initial
        qualify row_number() over (partition by id, person order by 2 * age_match::int + article_match::int desc, n_on, article) = 1)
select id, row_number() over (partition by id order by strength desc, name, person)::int as rank, person, article, age_match, article_match, by_initial from one qualify rank <= 5""")
def unnamed_named_elsewhere(spark: SparkSession, sf: str) -> DataFrame:
    """The five persons of other reports, of the same place and days, whom an unnamed one may be."""
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    gender = F.when(key % 3 == 0, "f").when(key % 3 == 1, "m")
    charge = F.array((F.floor("o_totalprice") % 13).cast("string"))
    asked = orders.filter("o_orderstatus = 'P'").select(
        key.alias("id"), key.alias("article"), F.col("o_orderdate").alias("on"), F.array("o_orderpriority").alias("places"), F.when(key % 2 == 0, "trial").alias("stage"), (key % 60).alias("age"),
        gender.alias("gender"), F.when(key % 5 == 0, "O.").otherwise("").alias("initial"), charge.alias("charges"),
    )
    named = orders.filter("o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("person"), F.concat_ws(" ", "o_orderstatus", _text("o_custkey")).alias("name"), key.alias("n_article"), F.col("o_orderdate").alias("n_on"), F.array("o_orderpriority").alias("n_places"),
        F.when(key % 4 == 0, "trial").otherwise("search").alias("n_stage"), gender.alias("n_gender"), F.concat(F.lit("aged "), (F.col("o_custkey") % 60).cast("string"), F.lit(" years")).alias("near"), charge.alias("n_charges"), F.lit(0).alias("n_start"),
    )
    none = spark.createDataFrame([], "id long, person long, decision string")
    return C.named_elsewhere(asked, named, none, 20, 5, r"(?<![0-9])([0-9]{1,3}) years")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    charges = F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 == 1, F.array(F.lit("AC 20.2"))).when(key % 4 == 2, F.array(F.lit("CC 207.3"), F.lit("AC 1"))).otherwise(F.array(F.lit("CC 1")))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "fine").when(F.col("o_orderpriority") != "5-LOW", "arrest").alias("event_type"),
        F.when(key % 7 != 0, F.date_sub(day, (F.col("o_custkey") % 400).cast("int"))).alias("event_on"), F.when(key % 11 != 0, day).alias("published"), charges.alias("charges"),
    )


@query("""
with r as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'fine' when '5-LOW' then null else 'arrest' end as t, case when o_orderkey % 7 <> 0 then o_orderdate::date - (o_custkey % 400)::int end as e,
                  case when o_orderkey % 11 <> 0 then o_orderdate::date end as p, o_orderkey % 4 >= 2 as crime, o_orderkey % 4 = 0 as free from orders),
a as (select *, not crime and (not free or coalesce(t = 'fine', false)) as adm from r)
select 'page' as view_, o_orderkey from a where not adm and p >= date '1996-01-01' and (e is null or e >= date '1996-01-01')
union all select 'criminal', o_orderkey from a where not adm and (crime or (free and t <> 'fine')) and p between date '1996-01-01' and date '1999-12-31'
union all select 'all', o_orderkey from a""")
def candidate_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by period, without administrative cases, criminal ones only, and all."""
    rows = _candidates(spark, sf)
    views = {"page": C.candidate_rows(rows, since="1996-01-01"), "criminal": C.candidate_rows(rows, since="1996-01-01", until="1999-12-31", criminal_only=True, by_event=False), "all": C.candidate_rows(rows, administrative=True)}
    out = [df.select(F.lit(name).alias("view_"), "o_orderkey") for name, df in views.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""
with r as (select o_orderstatus = 'P' as unnamed, o_orderkey % 5 = 0 as done, case o_orderkey % 3 when 0 then 'new_case' when 1 then 'sentence' end as kind, o_orderkey % 8 = 1 as awaited, case when o_custkey % 2 = 0 then 'none' else 'in_base' end as known
           from orders where o_orderkey % 9 <> 0 and o_orderdate::date between date '1995-01-01' and date '1998-06-30'),
c as (select count(*) filter (where not done) as "all", count(*) filter (where not done and kind = 'new_case') as new_case, count(*) filter (where not done and kind = 'sentence') as sentence, count(*) filter (where not done and unnamed) as unnamed,
             count(*) filter (where not done and awaited) as awaited, count(*) filter (where done) as done, count(*) filter (where not done and known = 'none') as not_in_base from r)
select queue, n from (unpivot c on "all", new_case, sentence, unnamed, awaited, done, not_in_base into name queue value n)""")
def result_queues(spark: SparkSession, sf: str) -> DataFrame:
    """What each queue of named and unnamed persons holds in a period; rows without a day are in none."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.alias("id"), F.when(key % 9 != 0, F.col("o_orderdate")).alias("on"), F.when(key % 3 == 0, "new_case").when(key % 3 == 1, "sentence").alias("kind"), (key % 5 == 0).alias("done"),
        F.when(F.col("o_custkey") % 2 == 0, "none").otherwise("in_base").alias("known"), (key % 8 == 1).alias("awaited"), "o_orderstatus",
    )
    sides = [rows.filter(c).drop("o_orderstatus") for c in ("o_orderstatus <> 'P'", "o_orderstatus = 'P'")]
    return C.queue_counts(C.result_rows(*sides, since="1995-01-01", until="1998-06-30"))


@query("""
with junk as (select l_orderkey as article, case when l_orderkey % 1000 <> 999 then min(l_discount) end as score from lineitem where l_returnflag = 'R' group by l_orderkey),
rest as (select article, score, article // 100 as b, article in (select c_custkey from customer) as judged from junk join orders on o_orderkey = article where o_orderdate >= timestamp '1995-01-01'),
stop as (select min(b) as b from rest where not judged and score is null)
select o_orderkey as article, 'outdated' as step from orders where o_orderdate < timestamp '1995-01-01'
union all select article, case when not judged and score >= 0.03 then 'held' else 'purged' end from rest where b < coalesce((select b from stop), 1e18)""")
def purge_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Outdated articles, then junk in batches up to the first failure of the screen."""
    articles = table(spark, sf, "orders").select(F.col("o_orderkey").alias("article"), F.col("o_orderdate").alias("on"))
    score = F.when(F.col("article") % 1000 != 999, F.min("l_discount"))
    junk = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("article")).agg(score.alias("score"))
    return C.purge_plan(articles, junk, table(spark, sf, "customer").select(F.col("c_custkey").alias("article")), "1995-01-01", 0.03, 100)


@query(r"""
with body as (select doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) as b, case when doc_id % 3 = 0 then 'never said' else trim(regexp_replace(substr(text, 11, 40), '\s+', ' ', 'g')) end as quote from documents)
select doc_id, source as person, quote, case when doc_id % 500 between 1 and 360 then doc_id % 500 else 0 end as months, source is not null and doc_id % 5 = 0 as hidden from body
where quote <> '' and doc_id % 4 <> 0 and contains(b, quote)""")
def proven_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings whose quote their document holds, of the known stages, with marks carried over."""
    docs, key = table(spark, sf, "documents"), F.col("doc_id")
    quote = F.when(key % 3 == 0, "never said").otherwise(F.regexp_replace(F.substring("text", 11, 40), " ", "  "))
    readings = docs.select("doc_id", F.col("source").alias("person"), quote.alias("quote"), F.when(key % 4 == 0, "other").otherwise("sentenced").alias("stage"), (key % 500).alias("months"))
    hidden = docs.filter(key % 5 == 0).select("doc_id", F.col("source").alias("person"))
    found = C.proven_readings(readings, docs, "doc_id", "text", {"stage": ["sentenced"]}, {"months": 360}, hidden)
    return found.select("doc_id", "person", "quote", F.col("months").cast("long").alias("months"), "hidden")


@query("""
select p_partkey, case when p_partkey % 10 <> 0 then p_name end as name, case when p_partkey % 10 = 0 then '' else
       'part ' || (p_partkey % 3 + 1) || ' art. ' || p_size || '.1 CC; ' || case when p_partkey % 9 > 4 then 'art. 20.' || p_partkey % 9 || ' AC' else 'part ' || p_partkey % 9 || '.2 art. 20 AC' end end as references_ from part""")
def registry_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Legal references of JSON cards by the slugs of a taxonomy; broken cards have none."""
    key, size = F.col("p_partkey"), _text("p_size")
    ninth = (key % 9).cast("string")
    classes = F.array(
        F.concat(F.lit("law-uk-"), size, F.lit("-1-ch-"), (key % 3 + 1).cast("string")), F.lower("p_brand"), F.lit("law-zz-1"), F.lit("law-uk-"),
        F.when(key % 9 > 4, F.concat(F.lit("law-koap-20-"), ninth)).otherwise(F.concat(F.lit("law-koap-20-ch-"), ninth, F.lit("-2"))),
    )
    raw = table(spark, sf, "part").select("p_partkey", F.when(key % 10 == 0, '{"name": ').otherwise(F.to_json(F.struct(F.col("p_name").alias("name"), classes.alias("classes")))).alias("card"))
    return C.registry_cards(raw, "card", "law-", {"uk": "CC", "koap": "AC"}).select("p_partkey", "name", F.array_join("references", "; ").alias("references_"))


@query(r"""
with w as (select p_partkey, unnest(regexp_extract_all(p_type || ' ' || p_name || ' of Ufa', '\p{L}+')) as w, unnest(range(len(regexp_extract_all(p_type || ' ' || p_name || ' of Ufa', '\p{L}+')))) as i from part),
k as (select *, lower(w) as f from w where lower(w) <> 'widget' and (length(w) > 3 or (length(w) = 3 and regexp_matches(w, '^\p{Lu}'))))
select p_partkey, string_agg(left(f, length(f) - case when length(f) > 5 then 2 else 1 end), ' ' order by i) as stems from k group by p_partkey""")
def stems_of_places(spark: SparkSession, sf: str) -> DataFrame:
    """Enough of each word of a place to find it declined; kinds of places are left out."""
    place = F.concat_ws(" ", "p_type", "p_name", F.lit("of Ufa"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(C.place_stems(place, ["widget"]), " ").alias("stems"))


@query("""
select o_orderkey from orders where o_orderstatus <> 'F' or o_orderkey % 10 = 0""")
def stale_by_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose run has another set of component versions than the current one."""
    current, before = {"extractor": "2", "normalizer": "1"}, {"extractor": "1", "normalizer": "1"}
    runs = table(spark, sf, "orders").select(
        "o_orderkey", F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 != 0), C.version_identity(dict(reversed(current.items())))).otherwise(C.version_identity(before)).alias("identity"),
    )
    return runs.filter(F.col("identity") != C.version_identity(current)).select("o_orderkey")
