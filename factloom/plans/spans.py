"""References, readings of names, repeats, gazetteers, descriptions, roles and charges over the whole texts of the documents.

The fixtures' prose is invented, so words with some ending stand for what a pattern finds in real texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import spans as S
from factloom.plans import matching as M
from factloom.plans.base import query, table

_ITEM, _LAST = "[a-z]+, ", "[a-z]+ of[ .]"
_READINGS = ("[A-Z][a-z]+ [a-z]+", "[A-Z][a-z]+ [a-z]+ [a-z]+", "[a-z]+[.] [A-Z][a-z]+")
_ALONE = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{3,}"
_PERSON, _PLACE = "(?:er|in)[a-z]{4,} [a-z]+", "th[a-z]{5,}"
_RULES = {
    "before_victim": "of ", "own_role": "ing", "before_role": "and ", "before_source": "the ", "after_speech": " (?:on|that)",
    "subordinate": "(?:that|in|of) ", "pronoun": " (?:the|it) ",
}
_CITATION, _SAID, _AND = "[a-z]+ation", "th", ("and", "of", "the", "in")


def _located_sql(name: str, pattern: str) -> str:
    return f"""{name} as (
    select doc_id, i, s, sum(gap + length(s)) over (partition by doc_id order by i)::bigint - length(s) as start, sum(gap + length(s)) over (partition by doc_id order by i)::bigint as "end" from (
        select doc_id, unnest(range(len(m))) as i, unnest(m) as s, unnest(list_transform(g[1:len(m)], lambda x: length(x))) as gap from (
            select doc_id, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g from documents)))"""


def _near_sql(name: str) -> str:
    kept = f"greatest(3, least(length(x), length({name})) - 2)"
    return f"len(list_filter(w, lambda x: x = {name} or (least(length(x), length({name})) >= 3 and left(x, {kept}) = left({name}, {kept})))) > 0"


_SENTENCES_SQL = r"""pieces as (
    select doc_id, s, sum(length(s)) over (partition by doc_id order by i)::bigint - length(s) as start from (
        select doc_id, unnest(l) as s, unnest(range(len(l))) as i from (
            select doc_id, string_split(replace(regexp_replace(text, '([.!?…])(\s)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(1) || chr(10) || chr(1)), chr(1)) as l from documents)))"""


@query(f"""
with {_located_sql("whole", f"(?:{_ITEM})*{_LAST}")},
parts as (select doc_id, start, "end", string_split(s, ', ') as p from whole),
each_ as (select doc_id, start, "end", p, unnest(range(1, len(p) + 1)) as j from parts)
select doc_id, (start + coalesce(list_sum(list_transform(p[1:j - 1], lambda x: length(x) + 2)), 0))::bigint as start, "end", j < len(p) as listed from each_""")
def enumerated_references(spark: SparkSession, sf: str) -> DataFrame:
    """References at the end of an enumeration, and its earlier members, which share it."""
    return S.enumerated_references(table(spark, sf, "documents"), "doc_id", "text", _ITEM, _LAST)


@query(rf"""
with {", ".join(_located_sql(f"r{i}", p) for i, p in enumerate(_READINGS))}, {_located_sql("taken", "the [a-z]+")},
readings as ({" union ".join(f'select doc_id, start, "end", s from r{i}' for i in range(len(_READINGS)))}),
free as (select r.* from readings r where not exists (select 1 from taken t where t.doc_id = r.doc_id and t.start < r."end" and r.start < t."end")),
known as (select distinct unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as w from conversations where turn = 0),
told as (select doc_id, start, "end", unnest(regexp_extract_all(lower(s), '[a-z]+')) as w from free),
counted as (select doc_id, start, "end", count(known.w) as n from told left join known on known.w = told.w group by doc_id, start, "end"),
kept as (select doc_id,
         list_reduce(list([{{'s': start, 'e': "end"}}] order by n desc, start - "end", start), lambda a, b: case when len(list_filter(a, lambda k: k.s < b[1].e and b[1].s < k.e)) = 0 then list_concat(a, b) else a end) as l from counted group by doc_id)
select doc_id, x.s as start, x.e as "end" from (select doc_id, unnest(l) as x from kept)""")
def name_readings(spark: SparkSession, sf: str) -> DataFrame:
    """One reading of each name: that with the most known words, then the longest."""
    docs, said = table(spark, sf, "documents"), table(spark, sf, "conversations").filter("turn = 0")
    known = said.select(F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("word")).distinct()
    return S.name_readings(docs, "doc_id", "text", _READINGS, known, S.located(docs, "doc_id", "text", "the [a-z]+"))


@query(f"""
with {_located_sql("full_", M.NAME)}, {_located_sql("alone", _ALONE)},
named as (select doc_id, start, "end", string_split(lower(s), ' ')[2] as w from full_),
surnames as (select doc_id, w, bool_or(not ends_with(w, 'e')) as any_ from named group by 1, 2)
select distinct a.doc_id, a.start, a."end" from alone a join surnames s on s.doc_id = a.doc_id and (w = lower(a.s) or (length(w) >= 3 and left(w, greatest(3, least(length(w), length(a.s)) - 2)) = left(lower(a.s), greatest(3, least(length(w), length(a.s)) - 2))))
where (not ends_with(a.s, 'n') or any_) and not exists (select 1 from named n where n.doc_id = a.doc_id and n.start < a."end" and a.start < n."end")""")
def surname_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words alone that repeat the surname of a full name of their document."""
    docs = table(spark, sf, "documents")
    surname = F.get(F.split("surface", " "), F.lit(1))
    names = S.located(docs, "doc_id", "text", M.NAME).select("doc_id", "start", "end", surname.alias("surname"), F.when(F.endswith(surname, F.lit("e")), "femn").alias("gender"))
    words = S.located(docs, "doc_id", "text", _ALONE).select("doc_id", "start", "end", F.col("surface").alias("word"), F.endswith("surface", F.lit("n")).alias("masculine"))
    return S.surname_repeats(names, words, "doc_id")


@query(rf"""
with {_located_sql("w", "[\\p{L}\\p{N}]+")},
entries as (
    select distinct array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')[1:case when item_id % 2 = 0 then 1 else 2 end], ' ') as entry, case when item_id % 2 = 0 then 'word' else 'phrase' end as kind from benchmark),
grams as (
    select doc_id, i, start, lower(s) as one, "end" as e1, lower(s) || ' ' || lower(lead(s) over o) as two, lead("end") over o as e2 from w window o as (partition by doc_id order by i)),
hits as (
    select doc_id, i, start, e1 as "end", entry, kind, 1 as n from grams join entries on entry = one
    union all select doc_id, i, start, e2, entry, kind, 2 from grams join entries on entry = two)
select doc_id, start, "end", entry, kind from (select *, max(n) over (partition by doc_id, i) as most from hits) where n = most""")
def gazetteer_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of one and two words in all documents, the longer one where both begin."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    short = F.col("item_id") % 2 == 0
    entry = F.array_join(F.slice(words, F.lit(1), F.when(short, 1).otherwise(2)), " ")
    gazetteer = table(spark, sf, "benchmark").select(entry.alias("entry"), F.when(short, "word").otherwise("phrase").alias("kind")).distinct()
    return S.gazetteer_hits(table(spark, sf, "documents"), "doc_id", "text", gazetteer, 2)


@query(rf"""
with {_SENTENCES_SQL},
told as (select doc_id, start + length(s) - length(regexp_replace(s, '^\s+', '')) as start, start + length(regexp_replace(s, '\s+$', '')) as "end", trim(regexp_replace(s, '\s+', ' ', 'g')) as sentence from pieces where contains(s, 'hable'))
select t.doc_id, start, "end", sentence, trim(regexp_replace(substr(d.text, greatest(start - 60, 0) + 1, "end" + 60 - greatest(start - 60, 0)), '\s+', ' ', 'g')) as context
from told t join documents d on d.doc_id = t.doc_id""")
def described_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with a description, and the text around them."""
    return S.described_sentences(table(spark, sf, "documents"), "doc_id", "text", "hable", 60)


@query(rf"""
with {_SENTENCES_SQL}, {_located_sql("p", _PERSON)}, {_located_sql("l", _PLACE)},
events as (select doc_id, s, start as s_start, start + length(s) as s_end, start + strpos(s, 'with') - 1 as trigger_ from pieces where contains(s, 'with')),
mentions as (select doc_id, start, "end", s as surface, 'person' as kind from p union all select doc_id, start, "end", s, 'place' from l),
met as (select m.*, e.*, m.start - s_start as at_ from mentions m join events e on e.doc_id = m.doc_id and m.start >= s_start and m."end" <= s_end),
cut as (select *, left(s, at_) as before, substr(s, at_ + 1) as from_, substr(s, "end" - s_start + 1, 40) as after, regexp_extract(left(s, at_), '[^,;:—]*$') as head, regexp_extract(substr(s, at_ + 1), '^[^,;:—]*') as tail from met)
select doc_id, s_start as event, start, case kind when 'person' then 'target' else 'location' end as role from cut
where kind <> 'person' or not (
    ends_with(before, 'of ') or starts_with(surface, 'ing') or ends_with(before, 'and ') or ends_with(before, 'the ') or starts_with(after, ' on') or starts_with(after, ' that')
    or (regexp_matches(head || tail, '^\s*(?:that|in|of) ') and regexp_matches(head, ' (?:the|it) ') and not (trigger_ >= start - length(head) and trigger_ < start + length(tail))))""")
def event_links(spark: SparkSession, sf: str) -> DataFrame:
    """Roles in the sentences that tell an event; sources, officials, victims and asides stay out."""
    docs = table(spark, sf, "documents")
    told = S.located(docs, "doc_id", "text", S.SENTENCE).filter(F.contains("surface", F.lit("with")))
    events = told.select("doc_id", F.struct("doc_id", "start").alias("event"), "start", "end", F.col("surface").alias("sentence"), (F.col("start") + F.position(F.lit("with"), F.col("surface")) - 1).alias("trigger"))
    found = [S.located(docs, "doc_id", "text", p).withColumn("kind", F.lit(kind)) for kind, p in (("person", _PERSON), ("place", _PLACE))]
    mentions = found[0].unionByName(found[1]).select("doc_id", F.col("start").alias("mention"), "kind", "start", "end", "surface")
    links = S.event_links(events, mentions, "doc_id", {"person": "target", "place": "location"}, _RULES)
    return links.select("event.doc_id", F.col("event.start").alias("event"), F.col("mention").alias("start"), "role")


@query(rf"""
with {M._NAMES_SQL},
cited as (
    select doc_id, unnest(range(len(m))) as i, unnest(m) as charge, unnest(g[1:len(m)]) as gap from (
        select doc_id, regexp_extract_all(text, '{_CITATION}') as m, string_split_regex(text, '{_CITATION}') as g from documents)),
near as (select doc_id, i, charge, list_filter(list_reverse(list_reverse(regexp_extract_all(lower(gap), '[\p{{L}}\p{{N}}]+'))[1:30]), lambda w: length(w) > 1) as w from cited),
rows_ as (select *, len(list_filter(w, lambda x: x not in ('and', 'of', 'the', 'in'))) = 0 as carried from near),
own as (
    select r.doc_id, i, charge, place, case when not carried then {_near_sql('given')} and {_near_sql('surname')} and contains(array_to_string(w, ' '), '{_SAID}') end as said
    from rows_ r join mentions n on n.doc_id = r.doc_id)
select distinct doc_id, place, charge from (select *, last_value(said ignore nulls) over (partition by doc_id, place order by i rows between unbounded preceding and current row) as so from own) where so""")
def charges_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """Charges that a document makes of each name in it."""
    docs = table(spark, sf, "documents")
    names = M.mentions(docs, "doc_id").select("doc_id", F.col("place").cast("long").alias("name"), F.array("given", "surname").alias("words"))
    return S.charges_of(docs, "doc_id", "text", names, _CITATION, _SAID, _AND, 30).select("doc_id", F.col("name").alias("place"), "charge")
