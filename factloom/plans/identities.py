"""Identity grouping over all names that documents mention, with endings of the fixtures' English as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import identity
from factloom.plans import matching as M
from factloom.plans.base import query, table

ENDINGS = (("ed", ""), ("ing", ""), ("ly", ""), ("s", ""))

_BASES = """list_distinct(list_filter([surname, case when ends_with(surname, 'ed') and length(surname) >= 5 then left(surname, length(surname) - 2) end,
    case when ends_with(surname, 'ing') and length(surname) >= 6 then left(surname, length(surname) - 3) end, case when ends_with(surname, 'ly') and length(surname) >= 5 then left(surname, length(surname) - 2) end,
    case when ends_with(surname, 's') and length(surname) >= 4 then left(surname, length(surname) - 1) end], lambda b: b is not null))"""


@query(f"""
with recursive {M._NAMES_SQL}, one as (select distinct left(given, 2) as scope, surname from mentions),
edges as (select scope, surname as a, unnest({_BASES}) as b from one),
both_ as (select scope, a, b from edges union select scope, b, a from edges),
reached as (select scope, a as node, a as root from both_ union select e.scope, e.b, r.root from reached r join both_ e on e.scope = r.scope and e.a = r.node)
select o.scope, o.surname, (select min_by(r.root, length(r.root) * 1000000 + 0) from reached r where r.scope = o.scope and r.node = o.surname and length(r.root) = (select min(length(x.root)) from reached x where x.scope = o.scope and x.node = o.surname)) as root from one o""")
def surname_root_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Declined surnames of a given name's scope as one."""
    every = M.every_name(spark, sf).select(F.left("given", F.lit(2)).alias("scope"), "surname")
    return identity.surname_roots(every, "scope", "surname", ENDINGS)


@query(f"""
with {M._NAMES_SQL}, keyed as (select doc_id, doc_id * 1000000 + place as mention, given || ' ' || surname as key, length(given) > 1 and length(surname) > 1 as is_full from mentions),
linked as (select k.mention, -1 - l.doc_id as person from labels l join keyed k on k.doc_id = l.doc_id where toxic = 1),
firsts as (select key, min(k.mention) as creator from keyed k left join linked l on l.mention = k.mention where l.person is null and is_full group by key)
select k.mention, case when l.person is null and is_full then f.creator else l.person end as person, l.person is null and is_full as new,
       case when l.person is not null then 'linked' when not is_full then 'review' when f.creator = k.mention then 'created' else 'same_batch' end as how
from keyed k left join linked l on l.mention = k.mention left join firsts f on f.key = k.key""")
def batch_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """All mentions linked to stored persons, or to the person that the first of their key creates."""
    number = (F.col("doc_id") * 1000000 + F.col("place")).alias("mention")
    every = M.mentions(table(spark, sf, "documents"), "doc_id").select("doc_id", number, F.concat_ws(" ", "given", "surname").alias("key"), ((F.length("given") > 1) & (F.length("surname") > 1)).alias("full"))
    linked = every.join(table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select("mention", (-1 - F.col("doc_id")).alias("person"))
    return identity.resolve_batch(every.drop("doc_id"), linked, ["mention"])
