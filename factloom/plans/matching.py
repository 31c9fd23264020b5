"""Entity resolution, list matching, classification and grouping over the names that documents mention.

The fixtures' prose has no names; three words from a capital on stand for one, wherever in a text they are. Every mention
counts; where a query is about a document's subject, that is its first mention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import classify, resolution
from factloom.operators.graph import components
from factloom.operators.listmatch import match_list
from factloom.plans.base import edits_sql, query, table
from factloom.storage import materialize

#: Evidence lexicon of the fixtures' invented English, as data.
LEXICON = {"charge": ["nation", "ationre"], "rights": ["thered", "inganat"], "press": ["ontheat", "whinger"], "faith": ["esheri", "thatin"]}

#: A name in the fixtures' prose: given name, surname, patronymic.
NAME = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+ [a-zß-öø-ÿ]+ [a-zß-öø-ÿ]+"

_NAMES_SQL = rf"""
mentions as (
    select doc_id, source, place, w[1] as given, w[2] as surname, w[3] as patronymic from (
        select doc_id, source, string_split(lower(unnest(l)), ' ') as w, unnest(range(len(l))) as place from (
            select doc_id, source, regexp_extract_all(text, '{NAME}') as l from documents))),
names as (select doc_id, source, given, surname, patronymic from mentions where place = 0)"""


def mentions(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns, place, given, surname, patronymic): every name of every whole text."""
    found = docs.select(*columns, F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("place", "name"))
    words = found.select(*columns, "place", F.split(F.lower("name"), " ").alias("w"))
    return words.select(*columns, "place", *[F.get("w", F.lit(i)).alias(c) for i, c in enumerate(("given", "surname", "patronymic"))])


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, given, surname, patronymic): the subject of each document, its first mention."""
    first = F.split(F.lower(F.regexp_extract("text", NAME, 0)), " ")
    words = table(spark, sf, "documents").select("doc_id", "source", first.alias("w")).filter(F.size("w") == 3)
    return words.select("doc_id", "source", *[F.get("w", F.lit(i)).alias(c) for i, c in enumerate(("given", "surname", "patronymic"))])


def every_name(spark: SparkSession, sf: str) -> DataFrame:
    """(given, surname, patronymic, incoming, known): the distinct names that documents mention; incoming: in one source, known: in others."""
    said = mentions(table(spark, sf, "documents"), "source")
    return said.groupBy("given", "surname", "patronymic").agg(F.bool_or(F.col("source") == "src0").alias("incoming"), F.bool_or(F.col("source") != "src0").alias("known"))


def _scored(spark: SparkSession, sf: str, plausible: bool = False) -> tuple[DataFrame, DataFrame]:
    """Incoming names, and their candidates among the known ones (all, or those that a decision may be about); a known person goes by its name."""
    parts = ("given", "surname", "patronymic")
    every = materialize(every_name(spark, sf), "names").withColumn("name", F.concat_ws(" ", *parts))
    known = every.filter("known").select(F.col("name").alias("person"), *[F.col(c).alias(f"k_{c}") for c in parts])
    incoming = every.filter("incoming").select("name", *parts)
    return incoming, resolution.candidates(incoming, known, plausible=plausible).withColumn("name", F.concat_ws(" ", *parts))


def _compare_sql(c: str) -> str:
    return f"""case when length({c}) = 1 or length(k_{c}) = 1 then case when left({c}, 1) = left(k_{c}, 1) then 'initial' else 'mismatch' end
        when {c} = k_{c} then 'exact' when {edits_sql(c, f'k_{c}')} <= case when greatest(length({c}), length(k_{c})) >= 10 then 2 when greatest(length({c}), length(k_{c})) >= 5 then 1 else 0 end then 'typo'
        else 'mismatch' end as m_{c}"""


_SCORED_SQL = f"""
with {_NAMES_SQL},
incoming as materialized (select distinct given || ' ' || surname || ' ' || patronymic as name, given, surname, patronymic, array_to_string(list_sort([given, surname, patronymic]), ' ') as key from mentions where source = 'src0'),
known as materialized (
    select distinct given || ' ' || surname || ' ' || patronymic as person, given as k_given, surname as k_surname, patronymic as k_patronymic, array_to_string(list_sort([given, surname, patronymic]), ' ') as key
    from mentions where source <> 'src0'),
near as materialized (
    select surname, k_surname from (select distinct surname from incoming) i join (select distinct k_surname from known) k
    on {edits_sql('surname', 'k_surname')} <= case when greatest(length(surname), length(k_surname)) >= 10 then 2 when greatest(length(surname), length(k_surname)) >= 5 then 1 else 0 end),
met as (
    select name, given, surname, patronymic, person, k_given, k_surname, k_patronymic, bool_or(by_key) as by_key, bool_or(not by_key) as by_name from (
        select name, given, surname, patronymic, person, k_given, k_surname, k_patronymic, true as by_key from incoming i join known k using (key)
        union all select i.name, i.given, i.surname, i.patronymic, k.person, k.k_given, k.k_surname, k.k_patronymic, false from incoming i join near n using (surname) join known k on k.k_surname = n.k_surname and left(k.k_given, 1) = left(i.given, 1)) group by all),
compared as (
    select name, person, concat_ws('+', case when by_key then 'key' end, case when by_name then 'name' end) as sources, {_compare_sql("surname")}, {_compare_sql("given")}, {_compare_sql("patronymic")},
           given = k_given and surname = k_surname and patronymic = k_patronymic as exact_form,
           length(given) > 1 and length(surname) > 1 and length(patronymic) > 1 as complete from met),
summed as (
    select *, case m_surname when 'exact' then 0.45::double when 'typo' then 0.30 else 0 end + case m_given when 'exact' then 0.30::double when 'typo' then 0.20 when 'initial' then 0.08 else 0 end
              + case m_patronymic when 'exact' then 0.20::double when 'typo' then 0.12 when 'initial' then 0.05 when 'missing' then 0.05 else 0 end + case when exact_form then 0.05::double else 0 end as v,
           m_surname = 'mismatch' or m_given = 'mismatch' or m_patronymic = 'mismatch' as conflict from compared),
valued as (
    select *, round(least(1.0::double, case when conflict then least(v, 0.25) when exact_form and complete then greatest(v, 0.85) else v end), 4) as score from summed),
scored as (select * from valued qualify row_number() over (partition by name order by score desc, person) <= 30)"""


@query(_SCORED_SQL + " select name, person, sources, m_surname, m_given, m_patronymic, exact_form, conflict, score from scored")
def er_candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by key and by surname up to a typo, 30 at most for each name that is mentioned, their parts compared and scored."""
    return _scored(spark, sf)[1].select("name", "person", "sources", "m_surname", "m_given", "m_patronymic", "exact_form", "conflict", "score")


@query(_SCORED_SQL + """,
everyone as (select n.name, s.person, s.score, coalesce(s.conflict, false) as conflict, length(n.given) > 1 and length(n.surname) > 1 as full_name from incoming n left join scored s on s.name = n.name),
ranked as (
    select *, person is not null and not conflict and score >= 0.4 as ok,
           row_number() over (partition by name order by case when person is not null and not conflict and score >= 0.4 then score end desc nulls last, person nulls first) as r from everyone),
one as (
    select name, max(score) filter (where r = 1 and ok) as top, max(score) filter (where r = 2 and ok) as second, max(person) filter (where r = 1 and ok) as chosen,
           count(*) filter (where ok) as plausible, count(*) filter (where ok and score >= 0.85) as strong, bool_and(full_name) as full_name from ranked group by name),
decided as (
    select *, round(top - coalesce(second, 0), 4) as margin,
           case when plausible = 0 then case when full_name then 'CREATE_NEW' else 'REVIEW' end
                when top < 0.85 or (round(top - coalesce(second, 0), 4) <= 0.1 and plausible > 1) or strong > 1 or not full_name then 'REVIEW' else 'AUTO_LINK' end as action from one)
select name, action, case when action = 'AUTO_LINK' then chosen end as selected, margin, plausible,
       concat_ws('; ', case when plausible = 0 then 'no plausible candidate' end, case when not full_name then 'incomplete name' end, case when top < 0.85 then 'low score' end,
                 case when margin <= 0.1 and plausible > 1 then 'small margin' end, case when strong > 1 then 'several strong candidates' end) as reasons from decided""")
def er_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Each name that is mentioned linked, reviewed, or made a new person."""
    incoming, found = _scored(spark, sf, plausible=True)
    full = incoming.select("name", ((F.length("given") > 1) & (F.length("surname") > 1)).alias("full"))
    scored = full.join(found.select("name", "person", "score", "conflict"), "name", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return resolution.decide(scored, "name", "person", "score", "conflict", "full")


@query(_SCORED_SQL + """,
there as (select distinct given || ' ' || surname || ' ' || patronymic as n from mentions join labels l using (doc_id) where quality = 1),
told as (select distinct s.name, s.person from scored s where s.name in (select n from there) and s.person in (select n from there)),
known_as as (select n.name, s.person, s.score, coalesce(s.conflict, false) as conflict, length(n.given) > 1 and length(n.surname) > 1 as full_name, t.name is not null as told
             from incoming n left join scored s on s.name = n.name left join told t on t.name = s.name and t.person = s.person),
ranked as (
    select *, person is not null and not conflict and score >= 0.4 as ok,
           row_number() over (partition by name order by case when person is not null and not conflict and score >= 0.4 then score end desc nulls last, person nulls first) as r from known_as),
one as (
    select name, max(score) filter (where r = 1 and ok) as top, max(score) filter (where r = 2 and ok) as second, max(person) filter (where r = 1 and ok) as best, count(*) filter (where ok) as plausible,
           count(*) filter (where ok and score >= 0.85) as strong, bool_and(full_name) as full_name, coalesce(bool_or(r = 1 and ok and told), false) as told from ranked group by name),
settled as (
    select *, round(top - coalesce(second, 0), 4) as margin,
           concat_ws('; ', case when not full_name then 'incomplete name' end, case when top < 0.85 then 'low score' end, case when round(top - coalesce(second, 0), 4) <= 0.1 and plausible > 1 then 'small margin' end,
                     case when strong > 1 then 'several strong candidates' end) as reasons from one where plausible > 0 and told)
select name, case when reasons = '' then 'AUTO_LINK' else 'REVIEW' end as action, case when reasons = '' then best end as selected, margin, plausible, reasons, best from settled""")
def er_redecided(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions while only names are known, and those reviews decided again of which documents of good quality name both sides."""
    parts = ("given", "surname", "patronymic")
    incoming, found = _scored(spark, sf, plausible=True)
    found = materialize(found.select("name", "person", "score", "conflict"), "scored")
    full = incoming.select("name", ((F.length("given") > 1) & (F.length("surname") > 1)).alias("full"))
    scored = full.join(found, "name", "left").withColumns({"conflict": F.coalesce("conflict", F.lit(False)), "proven": F.lit(False)})
    first = resolution.decide(scored, "name", "person", "score", "conflict", "full", "proven")
    reviewed = table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    there = materialize(mentions(reviewed, "doc_id").select(F.concat_ws(" ", *parts).alias("n")).distinct(), "named-in")
    beside = found.select("name", "person").join(there.withColumnRenamed("n", "name"), "name", "left_semi").join(there.withColumnRenamed("n", "person"), "person", "left_semi")
    return resolution.redecide(first, beside.select("name", F.col("person").alias("candidate")), "name")


_STEM = "greatest(3, least(length(w), length(e)) - 2)"
_MATCH_SQL = rf"""
listed as (
    select item_id * 1000 + place as entry, case when item_id % 4 = 1 then w[1:2] else w end as words, case when item_id % 2 = 0 then 1950 + (item_id + place) % 9 end as birth from (
        select item_id, string_split(lower(unnest(l)), ' ') as w, unnest(range(len(l))) as place from (select item_id, regexp_extract_all(text, '{NAME}') as l from benchmark))),
people as (select given || ' ' || surname || ' ' || patronymic as person, [given, surname, patronymic] as words, case when min(doc_id) % 3 = 0 then 1950 + min(doc_id) % 9 end as birth from mentions group by all),
everyone_ as (select person, words, birth from people union all select person, words[1:2], birth from people),
met as (
    select p.person, l.entry, max(case when p.birth is not null and l.birth is not null then case when p.birth = l.birth then least(s.score + 0.05, 1.0) else least(s.score, 0.5) end else s.score end) as score
    from everyone_ p join listed l on list_sort(p.words) = list_sort(l.words), lateral (select least(1.0::double, 0.8 + 0.2) as score) s group by all),
ranked as (select *, row_number() over (partition by person order by score desc, entry) as r from met where score > 0.5),
best as (select person, max(score) filter (where r = 1) as top, max(score) filter (where r = 2) as second, max(entry) filter (where r = 1) as entry from ranked group by person),
stems as (select person, list_transform(list_filter(words, lambda w: length(w) >= 3), lambda w: left(w, greatest(3, length(w) - 2))) as stems from people),
e_names as (select distinct words as e_words, array_to_string(words, ' ') as e_name from listed),
near as (select s.person, e.e_words from stems s join e_names e on len(list_filter(s.stems, lambda t: contains(e.e_name, t))) > 0),
variants as (
    select distinct n.person from near n join everyone_ p using (person)
    where len(list_filter(case when len(p.words) <= len(e_words) then p.words else e_words end, lambda w: len(list_filter(case when len(p.words) <= len(e_words) then e_words else p.words end, lambda e:
           (least(length(w), length(e)) >= 3 and left(w, {_STEM}) = left(e, {_STEM})) or (left(w, 1) = left(e, 1) and {edits_sql('w', 'e')} <= 2))) = 0)) = 0),
matched as (
    select p.person, b.entry, case when top is null and len(list_filter(p.words, lambda w: length(w) > 1)) < 2 then 'INSUFFICIENT_DATA'
           when top is null and v.person is not null then 'NEEDS_REVIEW' when top is null then 'NOT_MATCHED'
           when second is not null and top - second < 0.1 then 'AMBIGUOUS' when top >= 0.95 then 'MATCHED' else 'NEEDS_REVIEW' end as status, top
    from people p left join best b on b.person = p.person left join variants v on v.person = p.person)"""


def all_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, given, surname, patronymic): every name of every document, written once, as several joins read it."""
    return materialize(mentions(table(spark, sf, "documents"), "doc_id").drop("place"), "mentions")


def matches(spark: SparkSession, sf: str, said: DataFrame | None = None) -> DataFrame:
    """All names that documents mention against the names of benchmark items, with some births known and the first two words as an alias."""
    parts = ("given", "surname", "patronymic")
    every = (said or all_mentions(spark, sf)).groupBy(*parts).agg(F.min("doc_id").alias("first"))
    people = every.select(F.concat_ws(" ", *parts).alias("person"), F.array(*parts).alias("words"), F.when(F.col("first") % 3 == 0, 1950 + F.col("first") % 9).alias("birth"))
    item, listed = F.col("item_id"), mentions(table(spark, sf, "benchmark"), "item_id")
    entries = listed.select(
        (item * 1000 + F.col("place")).alias("entry"), F.when(item % 4 == 1, F.array("given", "surname")).otherwise(F.array(*parts)).alias("words"),
        F.when(item % 2 == 0, 1950 + (item + F.col("place")) % 9).alias("birth"),
    )
    people, entries = materialize(people, "people"), materialize(entries, "entries")
    return match_list(people, entries, aliases=people.select("person", F.slice("words", 1, 2).alias("words")))


@query(f"""
with {_NAMES_SQL}, {_MATCH_SQL}
select person, status, round(case when status = 'NOT_MATCHED' then 0.8::double else coalesce(top, 0) end, 6) as confidence, entry from matched""")
def list_match_status(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf)


def _found(kind: str) -> str:
    return f"case when regexp_matches(lower(text), '(^|[^a-zà-ÿ])({'|'.join(LEXICON[kind])})') then '{kind}' end"


_CLASSIFIED_SQL = f"""
kinds as (
    select d.doc_id, d.source, list_filter([{', '.join(_found(k) for k in LEXICON)}], lambda k: k is not null) as kinds, l.quality is not null and l.quality = 1 as has_event
    from documents d left join labels l on l.doc_id = d.doc_id),
classified as (
    select doc_id, source, kinds, case when len(kinds) = 0 then 'NON_POLITICAL' when not has_event then 'UNCERTAIN'
               when list_contains(kinds, 'charge') or len(kinds) >= 2 then 'POLITICAL' else 'UNCERTAIN' end as status,
           case when len(kinds) = 0 then 0.0::double when not has_event then 0.5 when list_contains(kinds, 'charge') or len(kinds) >= 2 then least(0.9, round(0.7 + (len(kinds) - 1) * 0.1, 6)) else 0.6 end as confidence
    from kinds)"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with kinds of evidence, status and confidence; a label of quality 1 stands for an event of its own."""
    marked = table(spark, sf, "documents").select("doc_id", "source", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    found = marked.select("doc_id", "source", classify.evidence(F.col("text"), LEXICON).alias("kinds"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("has_event"))
    kinds, event = F.col("kinds"), F.col("has_event")
    return found.select("doc_id", "source", "kinds", classify.status(kinds, "charge", event).alias("status"), classify.confidence(kinds, "charge", event).alias("confidence"))


@query(f"with {_CLASSIFIED_SQL} select doc_id, source, array_to_string(kinds, ',') as kinds, status, confidence from classified")
def keyword_evidence_classify(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).withColumn("kinds", F.array_join("kinds", ","))


@query("""
select p_partkey, coalesce(regexp_matches(p_type || ' ' || p_size, '(^|[^0-9.])(7|11|28)([^0-9.]|$)') and p_type <> 'SMALL', false)
       or (p_type = 'SMALL' and regexp_matches(p_type || ' ' || p_size, '(^|[^0-9.])(3|11)([^0-9.]|$)')) as listed from part""")
def charge_in_own_code(spark: SparkSession, sf: str) -> DataFrame:
    """An article number counts in its own code only."""
    charge = F.concat_ws(" ", "p_type", "p_size")
    return table(spark, sf, "part").select("p_partkey", classify.charge_listed(charge, ["7", "11", "28"], ["3", "11"], "small").alias("listed"))


@query(r"""
with recursive ends as (select doc_id, 'b' || left(text, 40) as k from documents where text <> '' union all select doc_id, 'e' || right(text, 40) from documents where text <> ''),
hubs as (select k, min(doc_id) as hub from ends group by k having count(*) > 1),
edges as (select e.doc_id as a, h.hub as b from ends e join hubs h using (k) where e.doc_id <> h.hub),
both_ as (select a, b from edges union select b, a from edges),
reached as (select a as node, a as root from both_ union select e.b, r.root from reached r join both_ e on e.a = r.node)
select node, min(root) as root from reached group by node""")
def merged_components(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a beginning or an end, transitively."""
    docs = table(spark, sf, "documents").filter("text <> ''")
    ends = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("b"), F.left("text", F.lit(40))), F.concat(F.lit("e"), F.right("text", F.lit(40))))).alias("k"))
    hubs = ends.groupBy("k").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    edges = ends.join(hubs, "k").filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    return components(edges)


@query(rf"""
with {_NAMES_SQL},
keyed as (select doc_id, place, given || ' ' || surname as k, patronymic from mentions),
known as (select k, min(patronymic) as p from keyed where length(patronymic) > 4 group by k having count(distinct patronymic) = 1)
select y.doc_id, y.place, y.k as name, coalesce(case when length(y.patronymic) > 4 then y.patronymic end, n.p) as patronymic from keyed y left join known n on n.k = y.k""")
def attach_weaker_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """A mention without a third part takes it from the fuller mentions of its key, where these agree on one."""
    long = F.when(F.length("patronymic") > 4, F.col("patronymic")).alias("patronymic")
    keyed = mentions(table(spark, sf, "documents"), "doc_id").select("doc_id", F.col("place").cast("long").alias("place"), F.concat_ws(" ", "given", "surname").alias("name"), long)
    full = keyed.filter("patronymic is not null").groupBy("name").agg(F.min("patronymic").alias("p"), F.max("patronymic").alias("q")).filter("p = q").select("name", "p")
    full = materialize(full, "fuller")  # a plain exchange on each side: Spark may split a name of many mentions
    return keyed.join(full, "name", "left").select("doc_id", "place", "name", F.coalesce("patronymic", "p").alias("patronymic"))


@query(rf"""
with {_NAMES_SQL}, one as (select distinct given, surname, patronymic from mentions)
select a.given, a.surname, a.patronymic, b.patronymic as other, case when {edits_sql('a.patronymic', 'b.patronymic')} <= 1 then 'similar' else 'patronymic' end as kind
from one a join one b on a.given = b.given and a.surname = b.surname and a.patronymic < b.patronymic""")
def dispute_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Names that agree but for the third part, all pairs: spelling, or another person."""
    return resolution.all_dispute_pairs(materialize(every_name(spark, sf).select("given", "surname", "patronymic"), "names"))
