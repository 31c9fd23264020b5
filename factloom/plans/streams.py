"""Streams drained to their final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.base import query
from factloom.streaming import jobs


@query("select user_id, event_type, count(*) as firsts from (select distinct user_id, event_type, (props->>'$.k')::bigint as k from events) group by all")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Each (user, type, k) once, however often the stream brings it."""
    stream = jobs.read_events(spark, f"{sf}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    once = jobs.deduplicate(stream.select("user_id", "event_type", "k", "at"), ["user_id", "event_type", "k"], "60 days")
    return jobs.drain(once, "stream-dedupe").groupBy("user_id", "event_type").agg(F.count("*").alias("firsts"))


@query("""
select event_type, time_bucket(interval 1 day, ts) as day, count(*) as events, max(value) as most from events
where time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour group by all""")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has closed."""
    stream = jobs.read_events(spark, f"{sf}/events.parquet").select("event_type", "value", "at")
    closed = jobs.drain(jobs.windowed_counts(stream, ["event_type"], "1 day", "1 hour"), "stream-days")
    return closed.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "events", "most")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each user and type, kept in the state store."""
    stream = jobs.read_events(spark, f"{sf}/events.parquet").select("user_id", "event_type", "event_id", "value")
    return jobs.upsert_stream(stream, ["user_id", "event_type"], "event_id", jobs.new_home(spark, "stream-upsert"))


@query("""
with led as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as fresh from events where user_id is not null),
numbered as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from led),
one as (select user_id, min(ts) as start, max(ts) + interval 2 hours as stop, count(*) as events from numbered group by user_id, n)
select * from one where stop <= (select max(ts) from events) - interval 1 hour""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users, two hours without an event apart, that the watermark has closed."""
    stream = jobs.read_events(spark, f"{sf}/events.parquet").select("user_id", "at").filter("user_id is not null")
    closed = jobs.drain(jobs.sessions(stream, "user_id", "2 hours", "1 hour"), "stream-sessions")
    return closed.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("stop"), "events")
