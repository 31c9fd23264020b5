"""Candidates (the flagship), findings, cases, and the junk screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import incremental, results, screen
from factloom.operators.memo import within_budget
from factloom.plans import matching as M
from factloom.plans.base import query, table


@query(f"""
with {M._NAMES_SQL}, {M._MATCH_SQL}, {M._CLASSIFIED_SQL},
active as (select d.doc_id as person from documents d left join labels l on l.doc_id = d.doc_id where coalesce(l.toxic, 0) = 0),
absent as (
    select x.doc_id as person, case when bool_and(m.status = 'NOT_MATCHED') then 'NOT_MATCHED' else 'LISTED' end as status
    from mentions x join matched m on m.person = x.given || ' ' || x.surname || ' ' || x.patronymic group by x.doc_id)
select c.doc_id as person, c.confidence, coalesce(m.status, 'NO_MATCH_RECORD') as list_status, d.source, d.n_chars, count(*) over (partition by d.source) as of_source
from classified c join active a on a.person = c.doc_id join documents d on d.doc_id = c.doc_id left join absent m on m.person = c.doc_id
where c.status = 'POLITICAL' and c.confidence >= 0.7 and coalesce(m.status, 'NO_MATCH_RECORD') = 'NOT_MATCHED'""")
def candidates_absent_from_list(spark: SparkSession, sf: str) -> DataFrame:
    """Active documents with strong evidence none of whose names may be in the list, with statistics of their source."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("person"), "source", "n_chars")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("person"), "toxic")
    active = docs.join(labels, "person", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    judged = M.classified(spark, sf).select(F.col("doc_id").alias("person"), "status", "confidence", F.lit(1).alias("classified_at"), F.col("doc_id").alias("id"))
    mentions = M.all_mentions(spark, sf)
    said = mentions.select(F.col("doc_id").alias("of"), F.concat_ws(" ", "given", "surname", "patronymic").alias("person"))
    absent = said.join(M.matches(spark, sf, mentions), "person").groupBy(F.col("of").alias("person")).agg(F.when(F.bool_and(F.col("status") == "NOT_MATCHED"), "NOT_MATCHED").otherwise("LISTED").alias("status"))
    found = results.candidates(judged, active, absent).join(docs, "person")
    counts = found.groupBy("source").agg(F.count("*").alias("of_source"))
    return found.join(counts, "source").select("person", "confidence", "list_status", "source", "n_chars", "of_source")


@query("""
with stored as (
    select user_id as person, bool_or(ts >= timestamp '2024-01-08') as active, 1 as first_seen_run, case when bool_or(ts >= timestamp '2024-01-08') then 2 else 1 end as last_seen_run
    from events where event_type = 'error' and ts < timestamp '2024-01-15' and value > 150 group by user_id),
found as (select distinct user_id as person from events where event_type = 'error' and ts >= timestamp '2024-01-15' and value > 150)
select coalesce(s.person, f.person) as person, f.person is not null as active, coalesce(first_seen_run, 3) as first_seen_run,
       case when f.person is not null then 3 else last_seen_run end as last_seen_run,
       case when s.person is null then 'created' when f.person is not null and not s.active then 'reactivated' when f.person is not null then 'kept' when s.active then 'deactivated' else 'inactive' end as change
from stored s full join found f on s.person = f.person""")
def findings_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of two weeks as stored findings, and what the next run makes of them."""
    bad = table(spark, sf, "events").filter("event_type = 'error' and value > 150").select(F.col("user_id").alias("person"), "ts")
    active = F.bool_or(F.col("ts") >= "2024-01-08")
    stored = bad.filter(F.col("ts") < "2024-01-15").groupBy("person").agg(active.alias("active"), F.lit(1).alias("first_seen_run"), F.when(active, 2).otherwise(1).alias("last_seen_run"))
    return results.upsert_findings(stored, bad.filter(F.col("ts") >= "2024-01-15"), 3)


_CASE_ROWS = """
rows_ as (select o_orderkey as id, o_custkey as person, o_orderpriority as reason, case when o_totalprice > 300000 then (o_totalprice / 20000)::int end as term,
                 strftime(o_orderdate, '%Y-%m') as "on", case when o_orderstatus = 'P' then '' else o_orderstatus end as region, o_totalprice as fine from orders),
ties as (select id, person, 'r' || reason as k from rows_ union all select id, person, 't' || term from rows_ where term is not null),
hubs as (select person, k, min(id) as hub from ties group by all),
edges as (select t.id as a, h.hub as b from ties t join hubs h on h.person = t.person and h.k = t.k),
both_ as (select a, b from edges union select b, a from edges),
reached as (select distinct a as node, a as root from both_ union select e.b, r.root from reached r join both_ e on e.a = r.node),
cases as (select node as id, min(root) as "case" from reached group by node)"""


def _case_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("reason"),
        F.when(F.col("o_totalprice") > 300000, F.rint(F.col("o_totalprice") / 20000).cast("int")).alias("term"),
        F.date_format("o_orderdate", "yyyy-MM").alias("on"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("region"), F.col("o_totalprice").alias("fine"),
    )


@query(f"""with recursive {_CASE_ROWS} select id, "case" from cases""")
def sentence_case_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of one person that share a reason or a term are one case."""
    return results.fold_cases(_case_rows(spark, sf))


@query(f"""with recursive {_CASE_ROWS},
of_case as (select c."case", r.* from rows_ r join cases c on c.id = r.id),
shown as (
    select "case", id as shown, "on", told as region from (
        select *, row_number() over w as r, first_value(nullif(region, '') ignore nulls) over (w rows between unbounded preceding and unbounded following) as told
        from of_case window w as (partition by "case" order by "on" desc, id desc)) where r = 1),
modes as (select "case", reason from (select "case", reason, row_number() over (partition by "case" order by count(*) desc, reason) as r from of_case group by "case", reason) where r = 1)
select t."case", count(*) as reports, max(fine) as fine, any_value(s.shown) as shown, any_value(s."on") as "on", any_value(s.region) as region, any_value(m.reason) as reason
from of_case t join shown s on s."case" = t."case" join modes m on m."case" = t."case" group by t."case" """)
def case_representatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = _case_rows(spark, sf)
    return results.represent_cases(rows.join(results.fold_cases(rows), "id"))


_UNIT = "list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))"


@query(f"""
with u as (select vec_id, label, {_UNIT} as v from embeddings),
parts as (select label = 0 as p, generate_subscripts(v, 1) as i, unnest(v) as x from u),
w as (select list(w order by i) as w from (select i, avg(x) filter (where p) - avg(x) filter (where not p) as w from parts group by i)),
scored as (select vec_id, label, 1 / (1 + exp(-(list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])) + 0.0))) as s from u, w)
select vec_id, round(s, 5) as score, case when s >= 0.56 then 'junk' when s <= 0.44 then 'keep' when s * s * 2 >= 0.5 then 'junk' else 'hold' end as verdict from scored""")
def logistic_screen_score(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings scored along the difference of the class means, and a cascade of two scores."""
    vectors = table(spark, sf, "embeddings")
    weights = screen.mean_difference(vectors, "embedding", F.col("label") == 0)
    scored = vectors.crossJoin(F.broadcast(weights)).select("vec_id", screen.linear_score(F.col("embedding"), F.col("weights"), 0.0).alias("s"))  # one row of weights
    return scored.select("vec_id", F.round("s", 5).alias("score"), screen.cascade(F.col("s"), F.col("s") * F.col("s") * 2, 0.44, 0.56).alias("verdict"))


@query("""
with answers as (select doc_id % 500 as key, md5(source) as digest, n_chars % 3 = 0 as answer, doc_id as stamp from documents where lang <> 'fr'),
asked as (select l.doc_id % 500 as key, md5(d.source) as digest, l.doc_id from labels l join documents d on d.doc_id = l.doc_id),
exact as (select key, digest, arg_max(answer, stamp) as a from answers group by all),
sticky as (select distinct key from answers where answer)
select q.doc_id, q.key, coalesce(e.a, case when s.key is not null then true end) as answer, case when e.a is not null then 'input' when s.key is not null then 'key' else 'ask' end as told_by
from asked q left join exact e on e.key = q.key and e.digest = q.digest left join sticky s on s.key = q.key""")
def memo_lookup_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by equal input, then an earlier yes for the key; the rest is to be asked."""
    docs = table(spark, sf, "documents")
    key = (F.col("doc_id") % 500).alias("key")
    answers = docs.filter("lang <> 'fr'").select(key, F.md5("source").alias("digest"), (F.col("n_chars") % 3 == 0).alias("answer"), F.col("doc_id").alias("at"))
    asked = table(spark, sf, "labels").select("doc_id").join(docs.select("doc_id", "source"), "doc_id").select("doc_id", key, F.md5("source").alias("digest"))
    return incremental.recall_answers(asked, answers, "key", "digest").select("doc_id", "key", "answer", "told_by")


@query("""
select s_suppkey, s_nationkey from supplier s where not exists (select 1 from customer c where c.c_nationkey = s.s_nationkey and c_acctbal > 9950)
  and not exists (select 1 from lineitem l where l.l_suppkey = s.s_suppkey and l_quantity = 50 and l_discount = 0.1)""")
def orphans_after_purge(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rich = table(spark, sf, "customer").filter("c_acctbal > 9950").select(F.col("c_nationkey").alias("s_nationkey"))
    sold = table(spark, sf, "lineitem").filter("l_quantity = 50 and l_discount = 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    return screen.orphans(screen.orphans(suppliers, "s_nationkey", [rich]), "s_suppkey", [sold]).select("s_suppkey", "s_nationkey")


@query("""
with e as (select user_id, ts::date as day, event_id from events where event_type = 'purchase'),
hubs as (select user_id, day, min(event_id) as hub from e group by all)
select e.event_id as id, h.hub as event from e join hubs h on h.user_id = e.user_id and h.day = e.day""")
def reports_to_events(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of one type, one day and one person are one event."""
    from factloom.operators.graph import components

    buys = table(spark, sf, "events").filter("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"), "event_id")
    hubs = buys.groupBy("user_id", "day").agg(F.min("event_id").alias("hub"))
    edges = buys.join(hubs, ["user_id", "day"]).select(F.col("event_id").alias("a"), F.col("hub").alias("b"))
    return components(edges).select(F.col("node").alias("id"), F.col("root").alias("event"))


@query("""
with asked as (select source as model, sha256(text) as input, max((doc_id % 4)::int) as priority, max(n_chars) as cost from documents where text is not null group by all),
memo as (select distinct d.source as model, sha256(d.text) as input from documents d join labels l on l.doc_id = d.doc_id where l.quality = 1 and d.text is not null),
budgets as (select source as model, sum(n_chars) // 3 as budget from documents where source <> 'src1' group by source),
summed as (select a.*, sum(cost) over (partition by model order by priority desc, md5(model || ':' || input), input rows unbounded preceding)::bigint as spent from asked a anti join memo m on a.model = m.model and a.input = m.input)
select s.model, s.input, s.priority, s.cost, s.spent from summed s join budgets b on b.model = s.model where spent <= budget""")
def asked_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that a source's model is asked about next: those without an answer, by priority, within a third of its characters."""
    docs = table(spark, sf, "documents")
    keyed = docs.filter("text is not null").select("doc_id", F.col("source").alias("model"), F.sha2(F.col("text").cast("binary"), 256).alias("input"), (F.col("doc_id") % 4).cast("int").alias("priority"), F.col("n_chars").alias("cost"))
    memo = keyed.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    budgets = docs.filter("source <> 'src1'").groupBy(F.col("source").alias("model")).agg(F.floor(F.sum("n_chars") / 3).alias("budget"))
    return within_budget(keyed, memo, budgets)
