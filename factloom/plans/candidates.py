"""Fuzzy candidates of the documents' subjects among the subjects of other sources and their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import similarity
from factloom.plans import matching as M
from factloom.plans.base import query

_GRAMS = "flatten(list_transform(string_split({}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
_JACCARD = "len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b})))"
_WORD = f"""coalesce(list_max(flatten(list_transform(h, lambda i: list_transform(list_filter(h, lambda j: j >= i), lambda j: {_JACCARD.format(a="t", b="o[i:j]")})))), 0)"""

_FUZZY_SQL = f"""
with {M._NAMES_SQL},
incoming as materialized (select distinct given || ' ' || surname || ' ' || patronymic as name from names where source = 'src0'),
persons as (select given || ' ' || surname || ' ' || patronymic as person from names where source <> 'src0' group by all),
forms as materialized (
    select person, person as form, false as alias from persons
    union all select person, string_split(person, ' ')[2] || ' ' || string_split(person, ' ')[1], true from persons where length(person) % 3 = 0),
ordered as materialized (select form, {_GRAMS.format("form")} as o, list_distinct({_GRAMS.format("form")}) as d from (select distinct form from forms)),
units as materialized (select name, name as unit, true as whole from incoming union select name, unnest(list_filter(string_split(name, ' '), lambda w: length(w) >= 3)), false from incoming),
asked as materialized (select distinct unit, whole, list_distinct({_GRAMS.format("unit")}) as t from units),
hits as materialized (
    select unit, whole, form, t, o, d, list_filter(range(1, len(o) + 1), lambda i: list_contains(t, o[i])) as h
    from asked join ordered on case when whole then {_JACCARD.format(a="t", b="d")} >= 0.3 else list_has_any(t, d) end),
valued as materialized (select unit, whole, form, case when whole then {_JACCARD.format(a="t", b="d")} else {_WORD} end as v from hits),
good as (select distinct name, form from units join valued using (unit, whole) where v >= case when whole then 0.3 else 0.5 end),
pairs as (select g.name, g.form, greatest({_JACCARD.format(a="n.t", b="o.d")}, coalesce(max(v.v), 0)) as v
          from good g join asked n on n.unit = g.name and n.whole join ordered o on o.form = g.form left join units u on u.name = g.name and not u.whole left join valued v on v.unit = u.unit and not v.whole and v.form = g.form
          group by g.name, g.form, n.t, o.d),
best as (select name, person, round(max(v), 4) as similarity from pairs join forms using (form) group by name, person),
fuzzy as (select * from best qualify row_number() over (partition by name order by similarity desc, person) <= 30)"""


def subjects(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Names of one source's subjects; persons of the others with their forms: the name, and for some an alias of two words turned round."""
    every = M.subjects(spark, sf).select("source", F.concat_ws(" ", "given", "surname", "patronymic").alias("name"))
    persons = every.filter("source <> 'src0'").select(F.col("name").alias("person")).distinct()
    words = F.split("person", " ")
    alias = F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0)))
    named = persons.select("person", F.col("person").alias("form"), F.lit(False).alias("alias"))
    return every.filter("source = 'src0'").select("name").distinct(), named.unionByName(persons.filter(F.length("person") % 3 == 0).select("person", alias.alias("form"), F.lit(True).alias("alias")))


@query(_FUZZY_SQL + " select name, person, similarity from fuzzy")
def trigram_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Persons similar to a subject's name, or to a word of it, 30 at most for each name."""
    incoming, forms = subjects(spark, sf)
    return similarity.trigram_candidates(incoming, forms.select("person", "form"))


@query(_FUZZY_SQL + """,
keyed as (
    select i.name, f.person, bool_or(not alias) as by_name, bool_or(alias) as by_alias from incoming i join forms f on list_sort(string_split(i.name, ' ')) = list_sort(string_split(f.form, ' ')) group by all),
keys as (select * from keyed qualify row_number() over (partition by name order by by_name desc, person) <= 30),
merged as (select coalesce(f.name, k.name) as name, coalesce(f.person, k.person) as person, f.similarity, coalesce(by_name, false) as by_name, coalesce(by_alias, false) as by_alias
           from fuzzy f full join keys k on f.name = k.name and f.person = k.person)
select name, person, concat_ws('+', case when by_alias then 'alias' end, case when by_name then 'exact_key' end, case when similarity is not null then 'trigram' end) as sources, similarity
from merged qualify row_number() over (partition by name order by by_name or by_alias desc, coalesce(similarity, 0) desc, person) <= 30""")
def merged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by key, alias and trigrams in one order."""
    incoming, forms = subjects(spark, sf)
    return similarity.merged_candidates(incoming, forms)
