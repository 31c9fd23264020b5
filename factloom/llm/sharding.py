"""Sharding of records by weighted rendezvous hashing (DataFrame functions only).

A record goes to the shard with the least ``-ln(u) / weight``, where u in (0, 1) comes from a hash of (key, shard). The
score of one shard does not depend on the others, so a new shard only takes the records on which it wins, and a removed
one only gives up its own.

Defined cases. A null key is hashed as the string ``null``; repeated keys share a shard and get slots of their own. Rows
that repeat whole are counted before they are shuffled, and numbered by their count. A null text has size 1 and the
checksum of no bytes. An empty table gives an empty result. Further columns are kept by ``assign_shards`` under any name
but those that it uses (shard, slot, _bucket, _row, _start, _copies), which are replaced or dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.base import gapless, table

#: Slots are counted in this many buckets a shard, so no task holds a whole shard.
SLOT_BUCKETS = 4096


def _unit(text: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of the digest."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard of each key; weights[i] > 0 is that of shard i. Ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct((-F.log(_unit(F.concat(name, F.lit(f":{i}")))) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_min(F.array(*scores))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], order: Sequence[str] = ()) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard, by bucket, key, then `order`).

    Buckets come from the key and `order`, 4,096 in each shard: neither a hot shard nor a key that many rows repeat is
    numbered in one task, and rows that are equal in all columns travel as one with their count.
    """
    df = df.drop("shard", "slot")
    once = df.groupBy(*df.columns).agg(F.count("*").alias("_times"))
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    bucket = F.conv(F.substring(F.md5(name.cast("binary")), 1, 3), 16, 10).cast("int")
    placed = once.withColumn("shard", rendezvous_shard(F.col(key), weights))
    by = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    return gapless(placed, ["shard"], bucket, by, "slot", SLOT_BUCKETS, "_times")


#: Weights of the query's second assignment: capacities of shards that differ.
CAPACITIES = [1.0, 2.0, 4.0, 1.5] * 4


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 15 of equal weight, law ``key``; grown_shard: with shard 16 added; weighted_shard: by CAPACITIES."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = assign_shards(docs, "doc_id", [1.0] * 16, ["text_crc32", "size"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        rendezvous_shard(F.col("doc_id"), [1.0] * 17).alias("grown_shard"),
        rendezvous_shard(F.col("doc_id"), CAPACITIES).alias("weighted_shard"),
    )


#: crc32 as DuckDB SQL: a fold of the bytes over the table of the reflected polynomial 0xEDB88320 (fixed value).
CRC32_SQL = """
    steps(i, c, k) as (
        select i, i::ubigint, 0 from range(256) r(i)
        union all
        select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from steps where k < 8),
    crc_table as (select list(c order by i) as t from steps where k = 8)"""

OP2_SQL = f"""
with recursive {CRC32_SQL},
hashed as (
    select doc_id, coalesce(text, '') as body, text is null as missing, coalesce(doc_id::varchar, 'null') as name from documents),
sized as (
    select doc_id, name, case when missing then 1 else octet_length(encode(body))::bigint + 1 end as size,
           hex(encode(body)) as h from hashed),
checked as (
    select doc_id, name, size,
           xor(list_reduce(
               list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::ubigint),
               lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255)::bigint + 1]), 4294967295::ubigint), 4294967295::ubigint)::bigint as text_crc32
    from sized, crc_table),
scored as (
    select doc_id, name, size, text_crc32,
           list_transform(range(17), lambda i: {{'score': -ln((('0x' || substr(md5(name || ':' || i), 1, 12))::ubigint::double + 0.5) / 281474976710656.0), 'shard': i}}) as s,
           list_transform(range(16), lambda i: {{'score': -ln((('0x' || substr(md5(name || ':' || i), 1, 12))::ubigint::double + 0.5) / 281474976710656.0) / {CAPACITIES}[i + 1], 'shard': i}}) as w,
           ('0x' || substr(md5(name || ':' || text_crc32 || ':' || size), 1, 3))::int as bucket
    from checked),
placed as (select *, list_min(s[1:16]).shard::int as shard, list_min(s).shard::int as grown_shard, list_min(w).shard::int as weighted_shard from scored)
select doc_id, size, text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by bucket, doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard, weighted_shard
from placed"""
