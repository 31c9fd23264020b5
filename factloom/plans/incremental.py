"""Pending and stale work, landing tables and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import incremental as I
from factloom.operators import joins as J
from factloom.operators import listmatch
from factloom.plans.base import query, table
from factloom.sources import snapshots as S

_RUNS_SQL = "runs as (select doc_id, case when toxic = 1 then 'v2' else 'v1' end as version, case when quality = 1 then 'succeeded' else 'failed' end as status from labels)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as a run log."""
    version, status = F.when(F.col("toxic") == 1, "v2").otherwise("v1"), F.when(F.col("quality") == 1, "succeeded").otherwise("failed")
    return table(spark, sf, "labels").select("doc_id", version.alias("version"), status.alias("status"), F.col("doc_id").alias("run"))


@query(f"with {_RUNS_SQL} select doc_id, source from documents d where not exists (select 1 from runs r where r.doc_id = d.doc_id and (status = 'succeeded' or version = 'v2'))")
def pending_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return I.pending(table(spark, sf, "documents").select("doc_id", "source"), _runs(spark, sf), "doc_id", "v2")


@query(f"""
with {_RUNS_SQL} select d.source, r.version as latest, count(*) as stale from documents d join runs r on r.doc_id = d.doc_id and r.status = 'succeeded' where r.version <> 'v2' group by all""")
def stale_version_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A dry run: how many documents of each source a new version would read again."""
    found = I.stale(table(spark, sf, "documents").select("doc_id", "source"), _runs(spark, sf), "doc_id", "v2")
    return found.groupBy("source", "latest").agg(F.count("*").alias("stale"))


@query("""
with evidence as (select user_id, max(ts) as changed from events where event_type <> 'view' group by user_id),
judged as (select user_id, max(ts) as judged_at from events where event_type = 'view' group by user_id)
select e.user_id, e.changed, j.judged_at from evidence e left join judged j using (user_id) where j.judged_at is null or j.judged_at < e.changed + interval 12 hour""")
def unsettled_judgements(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    evidence = events.filter("event_type <> 'view'").groupBy("user_id").agg(F.max("ts").alias("changed"))
    judged = events.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("judged_at"))
    return I.unsettled(evidence, judged, "user_id", "changed", "judged_at", "12 hours").select("user_id", "changed", "judged_at")


@query("""
with marks as (select user_id, min(ts) as stamp from events where event_type = 'signup' and value > 150 group by user_id),
news as (select user_id, max(ts) as n from events where event_type = 'error' and value > 200 group by user_id)
select m.user_id, m.stamp as at from marks m left join news n using (user_id) where n.n is null or n.n <= m.stamp""")
def valid_done_marks(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    marks = events.filter("event_type = 'signup' and value > 150").groupBy("user_id").agg(F.min("ts").alias("at"))
    return I.done_marks(marks, events.filter("event_type = 'error' and value > 200").select("user_id", F.col("ts").alias("at")), "user_id")


@query("""
select user_id as key, event_id as version, event_type from (
    select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1""")
def upsert_by_natural_key(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries of one table, and what a keep-latest landing table holds after both."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type", "ts")
    first, second = rows.filter(F.col("ts") < "2024-01-20").drop("ts"), rows.filter(F.col("ts") >= "2024-01-20").drop("ts")
    return S.upsert(first, second, ["key", "event_type"], "version")


@query("""
select sha256(text) as content_hash, count(*) over () as arrived from (
    select distinct text from documents where source <> 'src0' and text not in (select text from documents where source = 'src0'))""")
def unseen_by_content(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that one source delivers and another hasn't stored."""
    docs = table(spark, sf, "documents")
    stored = docs.filter("source = 'src0'").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    new = S.unseen(docs.filter("source <> 'src0'").select("text"), stored, "text").select("content_hash")
    return new.crossJoin(F.broadcast(new.agg(F.count("*").alias("arrived"))))  # one row


@query("""
with old as (select distinct user_id from events where ts < timestamp '2024-01-02'), new as (select distinct user_id from events where ts >= timestamp '2024-01-29 12:00:00'),
plan as (select coalesce(o.user_id, n.user_id) as user_id, case when o.user_id is null then 'add' when n.user_id is null then 'remove' else 'keep' end as action from old o full join new n on o.user_id = n.user_id)
select user_id, action, (select count(*) filter (where action = 'keep') >= 0.9 * count(*) filter (where action <> 'add') from plan) as safe from plan""")
def replace_whole_plan(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return S.sync_plan(events.filter(F.col("ts") < "2024-01-02"), events.filter(F.col("ts") >= "2024-01-29 12:00:00"), "user_id")


@query("""
select skip_reason, count(*) as documents from (
    select case when trim(coalesce(d.text, '')) = '' then 'no_text' when o.o_orderdate is null then 'unknown_date'
                when o.o_orderdate::date not between date '1996-01-01' and date '1999-12-31' then 'out_of_range' end as skip_reason
    from documents d left join orders o on o.o_orderkey = d.doc_id and o.o_orderstatus <> 'P') group by skip_reason""")
def admission_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dated by an order of their number: skips as rows, not as errors."""
    dates = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(dates, "doc_id", "left")
    return S.admission(docs, "text", "o_orderdate", "1996-01-01", "1999-12-31").groupBy("skip_reason").agg(F.count("*").alias("documents"))


@query("""
select doc_id, octet_length(encode(case when l.toxic = 1 then '' else text end))::bigint as bytes, case when l.toxic = 1 then 'expired' else 'text' end as content_type
from documents d left join labels l using (doc_id)""")
def purge_to_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.lit("text").alias("content_type"))
    marked = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    purged = S.tombstones(marked, F.coalesce(F.col("toxic") == 1, F.lit(False)), "content")
    return purged.select("doc_id", F.octet_length("content").cast("long").alias("bytes"), "content_type")


@query("""
with s as (select user_id, event_type as name, ts::date as day, max(value) as value from events group by all)
select user_id, name, day, value, last_value(case when value > 250 then value end ignore nulls) over (partition by user_id, name order by day rows between unbounded preceding and 1 preceding) as before from s""")
def snapshot_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """What the snapshots before a day knew of each name."""
    days = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("name"), F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    known = days.withColumn("sure", F.when(F.col("value") > 250, F.col("value")))
    return J.previous_value(known, ["user_id", "name"], "day", "sure", "before").drop("sure")


@query("""
with o as (select c_custkey as k, case when c_mktsegment <> 'BUILDING' then c_acctbal end as included from customer),
first_ as (select o_custkey as k, min(o_totalprice) as included from orders where o_orderstatus = 'F' group by 1), second_ as (select o_custkey as k, min(o_totalprice) as included from orders group by 1)
select o.k, coalesce(o.included, f.included, s.included) as included, case when o.included is not null then 0 when f.included is not null then 1 when s.included is not null then 2 end as told_by
from o left join first_ f on f.k = o.k left join second_ s on s.k = o.k""")
def inclusion_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A missing value from the first of several sources that knows it."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("included"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice", "o_orderstatus")
    least = lambda df: df.groupBy("k").agg(F.min("o_totalprice").alias("included"))
    return listmatch.fill_inclusion(base, [least(orders.filter("o_orderstatus = 'F'")), least(orders)], ["k"])
