"""Triggers, dates, antecedents, evidence windows, brackets, charges and corroboration, over sentences and mentions of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import context, dates, extraction
from factloom.operators import joins as J
from factloom.operators import spans as S
from factloom.plans import matching as M
from factloom.plans.base import query, table
from factloom.plans.spans import _SENTENCES_SQL, _located_sql

VERBS, NOUNS, NEGATIONS = {"opened": "with", "closed": "from"}, {"ruling": "tion", "notice": "ent"}, ("the", "of")
SENTENCES_SQL = r"""
sentences as (
    select doc_id, unnest(range(len(l))) as place, unnest(l) as s from (
        select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '((^|[^\s.(])[^\s\p{L}]|(^|[^\s.(])\p{L}|\p{L}\p{L}|[\s.(][^\s\p{L}])([.!?])\s+', '\1\4' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') as l
        from documents where text is not null))"""


def _trigger_sql(pattern: str) -> str:
    free = f"regexp_replace(lower(s), '(the|of) {pattern}', '\\1 {'#' * len(pattern)}', 'g')"
    return f"case when contains({free}, '{pattern}') then strpos({free}, '{pattern}') - 1 end"


@query(rf"""
with {SENTENCES_SQL},
placed as (select doc_id, place, {_trigger_sql("with")} as o, {_trigger_sql("from")} as c, {_trigger_sql("tion")} as r, {_trigger_sql("ent")} as n from sentences)
select doc_id, place, case when o is not null or c is not null then case when coalesce(o, 1e9) < coalesce(c, 1e9) then 'opened' else 'closed' end
       else case when coalesce(r, 1e9) < coalesce(n, 1e9) then 'ruling' else 'notice' end end as kind, coalesce(least(o, c), least(r, n)) as start
from placed where coalesce(o, c, r, n) is not null""")
def sentence_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event of each sentence of every document: its earliest verb without negation, else its earliest noun."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(extraction.sentences(F.col("text"))).alias("place", "s"))
    found = rows.select("doc_id", F.col("place").cast("long").alias("place"), context.first_trigger(F.lower("s"), VERBS, NOUNS, NEGATIONS).alias("t")).filter(F.col("t").isNotNull())
    return found.select("doc_id", "place", F.col("t.type").alias("kind"), F.col("t.start").cast("long").alias("start"))


#: Sentences with a written day in turn (d.m, d.m.Y and d month Y: the order's), and where each one's trigger begins.
SAID = [
    ("signed on {dm}", 0), ("on {dmy} at noon", 0), ("on 31.02.2001", 0), ("from 12.10 to {dm}", 0), ("article 20.2 of the code of 1.2.3", 0), ("on {dm} under article 20.2", 0),
    ("held until {words}", 0), ("on 12 and 13 {month}", 0), ("closed on {words}, after he had paid on 5.08.2019", 0), ("one of {words} of birth", 0), ("he came in 1999 on {day} {month}.", 0),
    ("paid on 5.08.2019, closed on {words}", 20), ("closed (on 1.1.2001) but opened on {dmy} - as told on 3.3.2003", 30), ("until now on {words}", 0),
]


@query(f"""
with said as (
    select o_orderkey, (o_orderdate + to_days((o_orderkey % 400)::int - 60))::date as published, o_orderkey % {len(SAID)} as form, o_orderdate::date as on_,
           strftime(o_orderdate, '-%m-%d') as md from orders),
read as (select *, try_cast(extract(year from published) || md as date) as this, try_cast((extract(year from published) - 1) || md as date) as last_ from said)
select o_orderkey, case when form in (1, 8, 11, 12, 13) then on_ when form in (0, 5, 10) then case when this <= published then this when published - last_ <= 120 then last_ end end as on_day from read""")
def dates_of_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Days that sentences write for their trigger, with the year of publication where it can be told; none for references, enumerated days, ends, births, and days that don't exist."""
    order, key = F.col("o_orderdate"), F.col("o_orderkey")
    forms = {"{dmy}": F.date_format(order, "dd.MM.yyyy"), "{dm}": F.date_format(order, "dd.MM"), "{words}": F.date_format(order, "d MMMM yyyy"), "{month}": F.date_format(order, "MMMM"), "{day}": F.date_format(order, "d")}
    sentence, trigger = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (text, at) in enumerate(SAID):
        filled = F.lit(text)
        for name, value in forms.items():
            filled = F.replace(filled, F.lit(name), value) if name in text else filled
        sentence, trigger = F.when(key % len(SAID) == i, filled).otherwise(sentence), F.when(key % len(SAID) == i, at).otherwise(trigger)
    published = F.date_add(order.cast("date"), (key % 400).cast("int") - 60)
    rows = table(spark, sf, "orders").select("o_orderkey", sentence.alias("sentence"), trigger.alias("trigger"), published.alias("published"))
    return rows.select("o_orderkey", dates.event_date(F.col("sentence"), F.col("trigger"), F.col("published"), 120, dates.ENGLISH).alias("on_day"))


@query(f"""
with {_located_sql("found", M.NAME)}, {_located_sql("feeds", chr(10))}, {_SENTENCES_SQL},
placed as materialized (
    select f.doc_id, f.start, f."end" as stop, case when length(string_split(f.s, ' ')[1]) % 2 = 0 then 'f' else 'm' end as gender, left(lower(string_split(f.s, ' ')[2]), 2) as root, coalesce(n.i + 1, 0) as paragraph
    from found f asof left join feeds n on n.doc_id = f.doc_id and f.start >= n.start),
told as (select doc_id, start, case when contains(s, ' it ') then 'm' else 'f' end as gender from pieces where contains(s, ' it ') or contains(s, ' that ')),
asked as (select t.*, coalesce(n.i + 1, 0) as paragraph from told t asof left join feeds n on n.doc_id = t.doc_id and t.start >= n.start),
pairs as materialized (select *, lag(root) over (partition by doc_id order by stop, start) as before from placed),
last_ as (select a.doc_id, a.start as sentence, a.gender, a.paragraph, p.start as mention, p.root, p.before, p.gender as own, p.paragraph as at_ from asked a asof join pairs p on p.doc_id = a.doc_id and a.start >= p.stop)
select doc_id, sentence, mention from last_ where root = before and own = gender and at_ = paragraph""")
def pronoun_antecedents(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences whose pronoun can mean one person only: the last two mentions agree, in gender and paragraph too."""
    docs = table(spark, sf, "documents")
    feeds = S.located(docs, "doc_id", "text", "\n").select("doc_id", F.col("start").alias("f_start"), (F.col("place") + 1).alias("feeds"))
    paragraph = lambda df: J.as_of_join(df, feeds, ["doc_id"], "start", "f_start", ["feeds"]).withColumn("paragraph", F.coalesce("feeds", F.lit(0))).drop("feeds")
    it, that = (F.contains("surface", F.lit(f" {w} ")) for w in ("it", "that"))
    sentences = paragraph(S.located(docs, "doc_id", "text", S.SENTENCE).filter(it | that).select("doc_id", F.col("start").alias("sentence"), "start", F.when(it, "m").otherwise("f").alias("gender")))
    given, surname = (F.get(F.split("surface", " "), F.lit(i)) for i in (0, 1))
    gender = F.when(F.length(given) % 2 == 0, "f").otherwise("m")
    mentions = paragraph(S.located(docs, "doc_id", "text", M.NAME).select("doc_id", F.col("start").alias("mention"), "start", "end", F.left(F.lower(surname), F.lit(2)).alias("surname"), gender.alias("gender")))
    return context.antecedents(sentences, mentions)


@query(f"""
with {_located_sql("found", M.NAME)}, {_located_sql("borders", "[,;:]")}, {_SENTENCES_SQL},
sentences as (select doc_id, start as s_start, start + length(s) as s_end from pieces where s <> ''),
placed as materialized (
    select m.doc_id, string_split(lower(m.s), ' ')[2] as person, m.start, m."end" as stop, s_start, s_end from found m asof join sentences s on m.doc_id = s.doc_id and m.start >= s.s_start),
ahead as (select p.*, b.start as n_start, b."end" as n_end from placed p asof left join borders b on p.doc_id = b.doc_id and p.stop <= b.start),
both_ as materialized (select p.*, b.start as p_start, b."end" as p_end from ahead p asof left join borders b on p.doc_id = b.doc_id and p.start >= b."end"),
inside as (
    select s.doc_id, s.person, s.start, s.stop, max(s.n_start) filter (where s.n_end <= o.start) as c_high, max(s.p_end) filter (where s.p_start >= o.stop) as c_low
    from both_ s join placed o on o.doc_id = s.doc_id and o.s_start = s.s_start and o.person <> s.person group by all),
outside as (
    select s.doc_id, s.person, s.start, s.stop, max(o.s_end) filter (where o.s_end <= s.s_start) as after, min(o.s_start) filter (where o.s_start >= s.s_end) as until_
    from placed s join placed o on o.doc_id = s.doc_id and o.person <> s.person and o.start > s.start - 20000 and o.start < s.stop + 20000
        and ((o.s_end <= s.s_start and o.s_end > s.start - 120) or (o.s_start >= s.s_end and o.s_start < s.stop + 120)) group by all),
wide as (
    select s.doc_id, s.person, greatest(0, s.start - 120, coalesce(after, 0), coalesce(c_low, 0)) as a, least(s.stop + 120, coalesce(until_, s.stop + 120), coalesce(c_high, s.stop + 120)) as b
    from placed s left join inside i on i.doc_id = s.doc_id and i.person = s.person and i.start = s.start left join outside o on o.doc_id = s.doc_id and o.person = s.person and o.start = s.start),
marked as (select *, case when a <= max(b) over (partition by doc_id, person order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from wide),
islands as (select *, sum(fresh) over (partition by doc_id, person order by a, b rows unbounded preceding) as island from marked)
select doc_id, person, min(a)::bigint as start, max(b)::bigint as stop from islands group by doc_id, person, island""")
def clipped_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of persons around their mentions in all documents, which stops at sentences and clauses that name others."""
    docs = table(spark, sf, "documents")
    located = lambda pattern: S.located(docs, "doc_id", "text", pattern)
    mentions = located(M.NAME).select("doc_id", F.get(F.split(F.lower("surface"), " "), F.lit(1)).alias("person"), "start", "end")
    found = context.evidence_windows(context.with_borders(mentions, located(S.SENTENCE), located("[,;:]")), 120, reach=20_000)
    return found.select("doc_id", "person", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


_KIN, _ENDINGS = ("the", "eine", "la", "le", "die", "to", "and"), ("a", "e", "s", "n")


@query(rf"""
with given as (select distinct unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as word from benchmark),
found as (
    select doc_id, m, string_split_regex(text, '{M.NAME}') as g, regexp_extract_all(text, '{M.NAME}') as l from (select doc_id, text, 0 as m from documents)),
each_ as (select doc_id, unnest(range(len(l))) as place, unnest(l) as surface, unnest(g[1:len(l)]) as before, g[len(g)] as after, len(l) as n from found),
told as (
    select *, place = n - 1 and regexp_full_match(after, '[.]?\s*') and regexp_matches(before, '[.!?…»"”)]\s*\n[ \t]*$') as signed, string_split(lower(surface), ' ') as w from each_),
bases as (select doc_id, place, w[2] as second, left(w[2], length(w[2]) - 1) as stem from told where w[1] in {_KIN}),
kin as (select distinct doc_id, place from (select doc_id, place, second, unnest([stem, {", ".join(f"stem || '{e}'" for e in _ENDINGS)}]) as base from bases) join given on word = base where base <> second)
select reason, count(*) as mentions, count(distinct doc_id) as documents from (
    select t.doc_id, case when signed then 'byline' when k.place is not null then 'kinship' else 'kept' end as reason from told t left join kin k on k.doc_id = t.doc_id and k.place = t.place) group by reason""")
def mentions_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    """All mentions, counted as authors' bylines, relatives and persons of the news."""
    given = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    found = context.mention_reasons(table(spark, sf, "documents"), "doc_id", "text", M.NAME, _KIN, given, _ENDINGS, r"[.]?\s*")
    each = found.groupBy("reason", "doc_id").agg(F.count("*").alias("n"))  # by document first: a reason of nearly all mentions is one sum a task
    return each.groupBy("reason").agg(F.sum("n").alias("mentions"), F.count("*").alias("documents"))


@query(f"""
with {_located_sql("found", M.NAME)},
placed as (select f.doc_id, f.start, f."end" as stop, substr(d.text, f.start, 1) as before, substr(d.text, f."end" + 1, 1) as after from found f join documents d on d.doc_id = f.doc_id),
led as (select *, lag(start) over w as named, start - lag(stop) over w as gap from placed window w as (partition by doc_id order by start))
select doc_id, start as alias, named from led where before = ' ' and after in (' ', '.', ',') and gap between 1 and 2""")
def aliases_in_brackets(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions right behind another one, between the marks that stand for brackets here: a blank, and a blank or a full stop."""
    docs = table(spark, sf, "documents")
    number = F.struct("doc_id", "start")
    found = S.marked(docs, "doc_id", "text", M.NAME).withColumn("mention", number)
    rows = found.withColumns({"before": F.when(F.col("before") == " ", "("), "after": F.when(F.col("after").isin(" ", ".", ","), ")")})
    return context.bracketed_aliases(rows).select("alias.doc_id", F.col("alias.start").alias("alias"), F.col("named.start").alias("named"))


@query("""
with t as (select distinct l_orderkey as event, l_partkey as target from lineitem where l_returnflag <> 'R'), n as (select event, count(*) - 1 as other_targets from t group by event),
b as (select distinct l_orderkey as event, l_suppkey as basis from lineitem where l_returnflag = 'R')
select t.event, t.target, b.basis, n.other_targets from t join n using (event) join b using (event)""")
def charges_of_events(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of events with their legal bases, and the number of other targets."""
    returned = F.col("l_returnflag") == "R"
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.when(returned, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("mention"), F.when(returned, "legal_basis").otherwise("target").alias("role"))
    return context.charges(links)


@query("""
with named as (select o_custkey as person, o_orderkey % 500 as article, o_orderdate::date as day_ from orders),
asked as (select event_id as mention, user_id as person, event_id % 500 as article, (ts - to_days(2000 + (event_id % 700)::int))::date as day_, event_type = 'error' as sole from events)
select distinct a.mention, a.person from asked a join named n on n.person = a.person and (n.article = a.article or (a.sole and abs(date_diff('day', a.day_, n.day_)) <= 30))""")
def corroborated_links(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whom the mention's own article, or a case within thirty days, speaks for."""
    named = table(spark, sf, "orders").select(F.col("o_custkey").alias("person"), (F.col("o_orderkey") % 500).alias("article"), F.col("o_orderdate").alias("on"))
    day = F.date_sub(F.col("ts").cast("date"), (2000 + F.col("event_id") % 700).cast("int"))
    asked = table(spark, sf, "events").select(F.col("event_id").alias("mention"), F.col("user_id").alias("person"), (F.col("event_id") % 500).alias("article"), day.alias("on"), (F.col("event_type") == "error").alias("sole"))
    return context.corroborated(asked, named, 30)
