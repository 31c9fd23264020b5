"""The trie of conversation prefixes: its nodes with members, leaves and the tokens that sharing each prefix saves.

A conversation is the sequence of its turns (role, text); each distinct sequence of first turns is a node. A turn goes by
128 bits of the SHA-256 of role and text, a conversation by its path, the digests in order. Sorted by path (and id), the
conversations are in the order in which a walk of the trie meets them, so a range of them, a shard, is a piece of the
trie whose only nodes in common with other shards are on the paths of its first and its last conversation: the spines.

Each shard is encoded as balanced parentheses, one pair a node, with the least and greatest excess of each block of BLOCK
parentheses and of each pair of blocks above. findclose goes through the blocks for the first place where the excess falls
below the node's own, which delimits the subtree, and enclose through them backwards, which gives the parent. The rank of
``()`` pairs counts leaves, cumulative arrays over the walk give members, tokens and savings of a subtree.

Spines merge by sums: of the shards that hold a node, the first one counts it among its parent's children and takes its
words off the savings, the last one counts it as a leaf. Members, children, leaves and savings then add up.

Scale: texts stay where they are read; digests, the first HEAD code points and counts of words are shuffled once by
conversation, once by range and once by shard. A shard has about SHARD_TURNS turns, whatever key is hot: copies of a
conversation are dealt over shards, and merge as a spine. What is merged is a row for each shard and node on its two
spines. A conversation's path is one value (16 bytes a turn). The members that end at one node are hashed in order, a
shard's part at a time, so no task holds them all; the digest itself can't be split.

Defined cases. Null role or text: empty. Null conv_id: takes no part. Null turn: first. Turns of equal number go by role,
the text's first HEAD code points, then its digest; repeated rows are turns of their own. No conversations: no nodes, not
even a root. Further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.base import materialize, table
from factloom.llm.sharding import CRC32_SQL

#: Bytes of a turn's digest; code points that order turns of equal number; turns of a shard, about; parentheses of a block.
DIGEST, HEAD, SHARD_TURNS, BLOCK = 16, 64, 1 << 18, 64
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations rebuilt from the same one, and what bounds the turns that they take from it.
FAMILY, MOST_HEAD = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: array of (digest, words) in order; texts don't leave their rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(2 * DIGEST))
    turn = F.struct(F.col("turn"), role.alias("role"), F.left(text, F.lit(HEAD)).alias("head"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    gathered = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(found: DataFrame) -> DataFrame:
    """sequences whose first h turns are those of the family's first conversation: h is the id's checksum modulo MOST_HEAD.

    The family of c begins with c - c % FAMILY (towards 0 for negative ids), which joins a family's members only.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD
    heads = found.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, MOST_HEAD - 1).alias("_heads"))
    joined = found.withColumn("_base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "_base", "left").withColumn("_h", h.cast("int"))
    head = F.when(F.col("_heads").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_heads", F.lit(1), F.col("_h")))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def in_shards(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, path, words and shard, ranges of (path, conv_id); a written table."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    plain = materialize(found.select("conv_id", path.alias("path"), F.col("turns.words").alias("words")), "trie-paths")
    turns = plain.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(found.sparkSession.sparkContext.defaultParallelism, -(-turns // shard_turns))
    return materialize(plain.repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id()), "trie-shards")


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """First turns that two paths share; -1 where there is no other path."""
    if a is None or b is None:
        return -1
    size = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, f"V{DIGEST}", size) for p in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else size


def shard_borders(sharded: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard, the turns that its first path shares with the shard before, and its last with the one after.

    One row a shard is numbered in one task, and two numbers of it come to the driver.
    """
    order = Window.orderBy("shard")
    edges = sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    edges = edges.select("shard", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, first, last, before, after = (c.to_pylist() for c in batch.columns)
            common = [[common_turns(a, b) for a, b in zip(*pair, strict=True)] for pair in ((first, before), (last, after))]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *[pa.array(c, pa.int64()) for c in common]], names=["shard", "before", "after"])

    return {r.shard: (r.before, r.after) for r in edges.mapInArrow(run, "shard int, before long, after long").collect()}


class Parentheses:
    """Balanced parentheses with their excess, and its range over blocks and pairs of blocks."""

    def __init__(self, opens: np.ndarray) -> None:
        """opens: True for an opening one."""
        self.opens = opens
        self.excess = np.concatenate([[0], np.cumsum(np.where(opens, 1, -1))])  # before each place, and at the end
        self.ahead, self.back = self._tree(self.excess), self._tree(self.excess[::-1])

    @staticmethod
    def _tree(excess: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(least, greatest) of each block, then of pairs of what is below, up to one."""
        padded = np.concatenate([excess, np.full(-len(excess) % BLOCK, excess[-1])]).reshape(-1, BLOCK)
        levels = [(padded.min(1), padded.max(1))]
        while len(levels[-1][0]) > 1:
            low, high = (np.concatenate([a, a[-1:]]) if len(a) % 2 else a for a in levels[-1])
            levels.append((low.reshape(-1, 2).min(1), high.reshape(-1, 2).max(1)))
        return levels

    @staticmethod
    def _reach(excess: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place after start where the excess is target, which is less than there; there is one for each."""
        found = np.full(len(start), -1)

        def scan(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
            """Look from each place to the end of its block; the rows that found nothing."""
            end, missed = np.minimum((place // BLOCK + 1) * BLOCK, len(excess)), [rows[:0]]
            while len(rows):
                hit = excess[place] == target[rows]
                found[rows[hit]] = place[hit]
                over = ~hit & (place + 1 >= end)
                missed.append(rows[over])
                on = ~hit & ~over
                rows, place, end = rows[on], place[on] + 1, end[on]
            return np.concatenate(missed)

        rows = scan(np.arange(len(start)), start + 1)
        block, wanted = (start[rows] + 1) // BLOCK + 1, target[rows]
        level, inside, holds = np.zeros(len(rows), int), np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        going = np.arange(len(rows))
        while len(going):  # up to a block that holds the target, then down to the first one in it that does
            for k in np.unique(level[going]).tolist():
                mine = going[level[going] == k]
                low, high = levels[k]
                holds[mine] = (low[block[mine]] <= wanted[mine]) & (wanted[mine] <= high[block[mine]])
            down, past = going[holds[going] & (level[going] > 0)], going[~holds[going]]
            level[down], block[down], inside[down] = level[down] - 1, 2 * block[down], True
            block[past] += 1
            up = past[~inside[past] & (block[past] % 2 == 0)]
            level[up], block[up] = level[up] + 1, block[up] // 2
            going = np.concatenate([down, past])
        scan(rows, block * BLOCK)
        return found

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where the pairs that open at these places close."""
        return self._reach(self.excess, self.ahead, at + 1, self.excess[at]) - 1

    def enclose(self, at: np.ndarray) -> np.ndarray:
        """Where the pairs open that hold those that open at these places (not the first, which nothing holds)."""
        last = len(self.excess) - 1
        return last - self._reach(self.excess[::-1], self.back, last - at, self.excess[at] - 1)


def prefix_keys(path: bytes, turns: int) -> list[bytes]:
    """Names of the prefixes of 0 to `turns` turns."""
    running = hashlib.sha256()
    keys = [running.digest()]
    for at in range(0, turns * DIGEST, DIGEST):
        running.update(path[at : at + DIGEST])
        keys.append(running.digest())
    return keys


NODES = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, shard int"


def shard_nodes(shard: pa.Table, before: int, after: int) -> pa.Table:
    """The nodes of a shard; those in common with its neighbours have a key, and their ends as text."""
    shard = shard.sort_by([("path", "ascending"), ("conv_id", "ascending")])
    paths, ids = shard.column("path").to_pylist(), shard.column("conv_id").to_numpy()
    number = int(shard.column("shard")[0].as_py())
    length = np.array([len(p) // DIGEST for p in paths])
    digests = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
    words = np.fromiter((w for ws in shard.column("words").to_pylist() for w in ws), np.int64, len(digests))
    starts = np.concatenate([[0], np.cumsum(length)])[:-1]

    # turns in common with the conversation before
    least = np.minimum(length[:-1], length[1:])
    within = np.arange(least.sum()) - np.repeat(np.cumsum(least) - least, least)
    differ = (digests[np.repeat(starts[:-1], least) + within] != digests[np.repeat(starts[1:], least) + within]).any(1)
    pair, first = np.unique(np.repeat(np.arange(len(least)), least)[differ], return_index=True)
    common = least.copy()
    common[pair] = within[differ][first]
    common = np.concatenate([[0], common])

    # nodes in the order of the walk, the root first
    new = length - common
    base = np.concatenate([[0], np.cumsum(new)])
    step = np.arange(base[-1]) - np.repeat(base[:-1], new)
    depth = np.concatenate([[0], np.repeat(common, new) + step + 1])
    own_words = np.concatenate([[0], words[np.repeat(starts + common, new) + step]])
    end = np.zeros(len(ids), int)  # the node at which each conversation ends: its last new one, or that of its copy before
    has = new > 0
    end[has] = base[1:][has]
    end = np.maximum.accumulate(end)
    nodes = len(depth)

    closes = np.concatenate([length[:-1] - common[1:], [length[-1] + 1]])
    counts = np.stack([new, closes], 1).ravel()
    counts[0] += 1
    pairs = Parentheses(np.repeat(np.tile([True, False], len(ids)), counts))
    opens = np.flatnonzero(pairs.opens)
    close = pairs.find_close(opens)
    beyond = np.arange(nodes) + (close - opens + 1) // 2  # the first node after the subtree
    rank = np.cumsum(pairs.opens) - 1  # of the last pair that opens at or before a place
    parent = np.concatenate([[-1], rank[pairs.enclose(opens[1:])]])

    # who counts what: the first shard of a node its words and its place among children, the last one its being a leaf
    owned = np.ones(nodes, np.int64)
    owned[: before + 1] = 0  # the first path is numbered by depth
    leaf = np.zeros(nodes, np.int64)
    leaf[rank[np.flatnonzero(pairs.opens[:-1] & ~pairs.opens[1:])]] = 1
    if after >= length[-1]:
        leaf[end[-1]] = 0
    so_far = lambda a: np.concatenate([[0], np.cumsum(a)])
    over = lambda a: so_far(a)[beyond] - so_far(a)[:nodes]
    members = over(np.bincount(end, minlength=nodes))
    children = np.bincount(parent[1:], owned[1:], nodes).astype(np.int64)
    saved = over((members - owned) * own_words)

    low, high = np.searchsorted(end, np.arange(nodes)), np.searchsorted(end, beyond)
    smallest = np.minimum.reduceat(np.append(ids, ids[-1:]), np.stack([low, high], 1).ravel())[::2]

    keys: dict[int, bytes] = {}
    if before >= 0:
        keys |= dict(enumerate(prefix_keys(paths[0], before)))
    if after >= 0:
        spine = {int(d): v for v, d in enumerate(depth.tolist()) if d <= after}  # the last node of each depth
        keys |= {spine[d]: k for d, k in enumerate(prefix_keys(paths[-1], after))}
    ends_at = np.searchsorted(end, np.arange(nodes), "right")
    ends: list[str | None] = [None] * nodes
    digest: list[str | None] = [NO_ENDS] * nodes
    for v in np.flatnonzero(ends_at > low).tolist():
        text = ",".join(map(str, ids[low[v] : ends_at[v]].tolist()))
        if v in keys:
            ends[v] = text
        else:
            digest[v] = hashlib.sha256(text.encode()).hexdigest()
    for v in keys:
        digest[v] = None
    above = [keys.get(p) for p in parent.tolist()]
    local = [None if k is not None or p < 0 else int(smallest[p]) for k, p in zip(above, parent.tolist(), strict=True)]
    long = lambda a: pa.array(a, pa.int64())
    return pa.table({
        "key": pa.array([keys.get(v) for v in range(nodes)], pa.binary()), "parent_key": pa.array(above, pa.binary()), "depth": long(depth), "conv_id": long(smallest),
        "parent_conv_id": long(local), "n_convs": long(members), "n_children": long(children), "n_leaves": long(over(leaf)), "saved_tokens": long(saved),
        "ends_sha256": pa.array(digest, pa.string()), "ends": pa.array(ends, pa.string()), "shard": pa.array([number] * nodes, pa.int32()),
    })


def ends_of(parts: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes whose ends lie in several shards: ends are hashed in the order of shards, a part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["key", "ends_sha256"])
        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                if own.as_py() != key:
                    if key is not None:
                        yield row()
                    key, running = own.as_py(), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(text.as_py().encode())
        if key is not None:
            yield row()

    dealt = parts.filter(F.col("ends").isNotNull()).repartition("key").sortWithinPartitions("key", "shard")
    return dealt.select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node of the trie of `found` (conv_id, turns as sequences gives them)."""
    sharded = in_shards(found, shard_turns)
    borders = sharded.sparkSession.sparkContext.broadcast(shard_borders(sharded))  # two numbers a shard

    def run(shard: pa.Table) -> pa.Table:
        return shard_nodes(shard, *borders.value[shard.column("shard")[0].as_py()])

    parts = materialize(sharded.groupBy("shard").applyInArrow(run, NODES), "trie-nodes")
    shared = parts.filter(F.col("key").isNotNull())
    summed: list[Column] = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = shared.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *summed)
    merged = materialize(merged.join(ends_of(shared), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "trie-spines")
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    alone = parts.filter(F.col("key").isNull())
    under = alone.filter(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(names, "parent_key")
    spines = merged.join(names, "parent_key", "left")
    return alone.filter(F.col("parent_key").isNull()).select(*COLUMNS).unionByName(under.select(*COLUMNS)).unionByName(spines.select(*COLUMNS))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(materialize(sequences(table(spark, sf_dir, "conversations")), "sequences")))


OP11_SQL = f"""
with recursive {CRC32_SQL},
turns as materialized (
    select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as t,
           len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as words, turn, coalesce(role, '') as role, coalesce(text, '') as body
    from conversations where conv_id is not null),
numbered as materialized (select conv_id, t, words, row_number() over (partition by conv_id order by turn nulls first, role, body[:{HEAD}], t) as i from turns),
ids as materialized (
    select conv_id, (xor(list_reduce(
        list_transform(range(0, length(conv_id::varchar)), lambda i: ascii(substr(conv_id::varchar, i + 1, 1))::ubigint),
        lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255)::bigint + 1]), 4294967295::ubigint), 4294967295::ubigint) % {MOST_HEAD})::int as h
    from (select distinct conv_id from turns), crc_table),
rebuilt as materialized (
    select conv_id, t, words, row_number() over (partition by conv_id order by own, i) as d from (
        select c.conv_id, n.t, n.words, false as own, i from ids c join numbered n on n.conv_id = c.conv_id - c.conv_id % {FAMILY} and n.i <= c.h
        union all select c.conv_id, n.t, n.words, true, i from ids c join numbered n on n.conv_id = c.conv_id and n.i > c.h)),
paths as materialized (
    select conv_id, 0 as d, '' as path, 0 as words from ids
    union all select conv_id, d, string_agg(t, '') over (partition by conv_id order by d) as path, words from rebuilt),
named as materialized (select conv_id, d, md5(path) as node, words, d = max(d) over (partition by conv_id) as last from paths),
nodes as materialized (
    select node, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
           sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256 from named group by node),
above as materialized (select distinct b.node, a.node as parent from named a join named b on a.conv_id = b.conv_id and b.d = a.d + 1),
under as materialized (select distinct a.node, b.node as below from named a join named b on a.conv_id = b.conv_id and b.d >= a.d),
children as (select parent as node, count(*) as n from above group by parent),
sums as (
    select u.node, sum((n.n_convs - 1) * n.words)::bigint as saved_tokens, count(*) filter (where c.n is null) as n_leaves
    from under u join nodes n on n.node = u.below left join children c on c.node = u.below group by u.node)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s using (node) left join children c using (node) left join above a using (node) left join nodes p on p.node = a.parent"""
