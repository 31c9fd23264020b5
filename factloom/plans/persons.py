"""Merges, clear pairs, officials, ages carried on, descriptions once, keys of names and the quality of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import extraction, identity, unnamed
from factloom.operators import spans as S
from factloom.plans.base import query, table
from factloom.plans.spans import _located_sql


@query("""
with f as (select distinct l_partkey - case when l_partkey % 4 in (1, 2) then l_partkey % 4 else 0 end as person, l_suppkey as fact from lineitem) select person, fact from f""")
def facts_of_merged_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of parts that were merged into others, through chains of two steps."""
    key = F.col("p_partkey")
    persons = table(spark, sf, "part").select(key.alias("person"), F.when((key % 4).isin(1, 2), key - 1).alias("merged_into"))
    facts = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("person"), F.col("l_suppkey").alias("fact"))
    return identity.merge_people(persons, {"facts": facts})["facts"].select("person", "fact")


@query("""
with e as (select p_partkey as key, p_size as mentions, p_partkey - p_partkey % 4 as g from part where p_partkey % 4 < 3),
n as (select g from e group by g having count(*) > 1)
select key, first_value(key) over (partition by g order by mentions desc, key) as into_ from e where g in (select g from n)""")
def merged_by_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that decided pairs tie together become the most mentioned of them."""
    key = F.col("p_partkey")
    parts = table(spark, sf, "part")
    entities = parts.select(key.alias("key"), F.col("p_size").alias("mentions"))
    here = parts.select((key - 1).alias("a"), key.alias("b")).filter((F.col("a") % 4).isin(0, 1))
    pairs = here.join(entities.select(F.col("key").alias("a")), "a", "left_semi")
    return identity.merge_decided(entities, pairs).withColumnRenamed("into", "into_")


@query("""
with p as (select distinct o_orderkey - (o_orderkey % 3 = 0)::int as a, 100000000 + o_custkey * 8 + o_orderkey % 8 as b from orders),
n as (select key from (select a as key from p union all select b from p) group by key having count(*) = 1)
select a, b from p where a in (select key from n) and b in (select key from n)""")
def pairs_without_rivals(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of which each side stands in no other pair."""
    pairs = table(spark, sf, "orders").select((F.col("o_orderkey") - (F.col("o_orderkey") % 3 == 0).cast("int")).alias("a"), (100000000 + F.col("o_custkey") * 8 + F.col("o_orderkey") % 8).alias("b")).distinct()
    return identity.clear_pairs(pairs)


@query("""
with c as (select p_brand || p_size % 7 as key, count(*) as mentions, count(*) filter (where regexp_matches(p_type, 'TIN|STEEL|SMALL') and not regexp_matches(p_type, 'ECONOMY|LARGE')) as titled from part group by 1)
select * from c where titled >= 2 or (titled > 0 and titled * 2 >= mentions)""")
def persons_in_office(spark: SparkSession, sf: str) -> DataFrame:
    """Those with a title in two mentions, or in half of them; a former title never counts."""
    mentions = table(spark, sf, "part").select(F.concat("p_brand", (F.col("p_size") % 7).cast("string")).alias("key"), F.col("p_type").alias("before"))
    return identity.officials(mentions, "TIN|STEEL|SMALL", "ECONOMY|LARGE").select("key", "mentions", "titled")


@query("""
select l_orderkey as article, l_linenumber as start, (l_quantity::int % 5)::int as age, l_returnflag as sex, l_linestatus as place from lineitem
qualify row_number() over (partition by l_orderkey, l_quantity::int % 5, l_returnflag, l_linestatus order by l_linenumber) = 1""")
def descriptions_once(spark: SparkSession, sf: str) -> DataFrame:
    """Described persons of an article once: the first of each age, sex, place and initial."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("article"), F.col("l_linenumber").alias("start"), (F.col("l_quantity").cast("int") % 5).alias("age"), F.col("l_returnflag").alias("sex"),
        F.col("l_linestatus").alias("place"), F.lit("").alias("initial"),
    )
    return identity.unnamed_once(rows).drop("initial")


@query("""
select o_orderkey, (18 + o_custkey % 60 + floor(date_diff('day', o_orderdate::date, date '2003-03-01') / 365.25) - 1)::bigint as low,
       (18 + o_custkey % 60 + floor(date_diff('day', o_orderdate::date, date '2003-03-01') / 365.25) + 1)::bigint as high from orders""")
def ages_years_later(spark: SparkSession, sf: str) -> DataFrame:
    """What an age that was told once is on a later day."""
    told = table(spark, sf, "orders").select("o_orderkey", (18 + F.col("o_custkey") % 60).alias("age"), F.col("o_orderdate").cast("date").alias("told_on"), F.lit("2003-03-01").cast("date").alias("on"))
    return unnamed.carried_age(told).select("o_orderkey", F.col("age_low").cast("long").alias("low"), F.col("age_high").cast("long").alias("high"))


@query(r"""
select p_partkey, regexp_replace(lower(trim(p_name || ' Ё-' || p_size)), '[^\p{L}0-9]', '', 'g') as raw, list_transform(string_split(p_name, ' '), lambda w: left(w, greatest(3, length(w) - 2))) as stems
from part""".replace("lower(trim(p_name || ' Ё-' || p_size))", "replace(lower(trim(p_name || ' Ё-' || p_size)), 'ё', 'е')"))
def keys_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup keys and stems of names."""
    name = F.concat("p_name", F.lit(" Ё-"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", X.matching_key(name).alias("raw"), F.transform(F.split("p_name", " "), lambda w: X.stem(w)).alias("stems"))


@query(f"""
with {_located_sql("found", "th[a-z]+[.,]")}, {_located_sql("gold", "th[a-z]+[.,]?")},
both_ as (select f.start as f, g.start as g from found f full join gold g on f.doc_id = g.doc_id and f.start = g.start and f."end" = g."end"),
n as (select count(*) filter (where f is not null and g is not null) as hit, count(f) as p, count(g) as g from both_)
select hit, hit / p as precision, hit / g as recall, 2 * (hit / p) * (hit / g) / (hit / p + hit / g) as f1 from n""")
def spans_against_golden(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of one pattern's spans against another's, over all texts."""
    docs = table(spark, sf, "documents")
    return extraction.score_spans(S.located(docs, "doc_id", "text", "th[a-z]+[.,]"), S.located(docs, "doc_id", "text", "th[a-z]+[.,]?"), ["doc_id", "start", "end"])
