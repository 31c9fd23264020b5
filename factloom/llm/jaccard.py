"""N-gram Jaccard join by vertical partitioning: near-duplicate classes of documents.

A document's set holds 64-bit fingerprints of its word n-grams. A global order of n-grams (rare before frequent by classes
of their counts, then by fingerprint) is cut into fragments; the overlaps of each fragment are counted separately, by
Spark key, and summed for each pair.

1. Counts. Tasks count their fingerprints, and pieces of the key space sum them: a filter of n-grams that occur more than
   once and the most frequent ones, both sized by the corpus up to a fixed bound. They steer the order and save work;
   whatever they hold, the result is exact, because any one order is valid.
2. Candidates. Two sets that link share at least SHARED of the first n-grams of both, at places that their sizes
   bound. Rare n-grams (SMALL documents at most) give pairs, whose shared n-grams are counted; a frequent one ties its
   documents to the least of them. Clusters are the components of these candidates.
3. Overlaps. The sets of a cluster are cut at the fragments' borders, and (cluster, fragment) is the key: a task holds one
   fragment's part of the sets, so that many more documents fit in it than whole sets would. It emits partial overlaps:
   of the pairs that meet, in a small cluster; as one compressed matrix, in a large one, whose documents are dealt over
   blocks that meet two by two. A second shuffle by cluster (and block pair) sums the partial overlaps and decides each
   pair. All pairs of a cluster are decided, none is emitted as a row: a task returns each node's root and number of links.
4. Classes are the components of those roots.

Shuffles: compressed counts, some shared n-grams of each document, the texts of documents that are in a cluster with
others, their fingerprints by fragment, and the partial overlaps. Hot groups (copies, near copies, passages) meet only as
partial aggregates, skew-splittable joins, and blocks of BLOCK documents and BLOCK_PRINTS n-grams.

Defined cases. Null or blank text: empty set, linked with nothing, its own component. Fewer words than the width: the whole
sequence is the one n-gram. Equal sets are one node, whatever their texts. Null keys are kept, and ignored in the least key of a component.
Repeated rows have a result each, and are one row of their node. Further columns are dropped. An empty table gives an empty result. A pair's overlap is wrong
only where two of its own n-grams have one fingerprint, a chance of |a||b| / 2^64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.base import gapless, materialize, table
from factloom.operators.graph import components

#: Key bits of the counts; bits of the filter for an n-gram of the corpus are one, within these bounds (64 MB at most).
KEY_BITS, LEAST_FILTER, MOST_FILTER = 36, 1 << 23, 1 << 29
#: One in so many n-grams is kept as a frequent one, within these bounds, and the count from which they are.
FREQUENT_SHARE, LEAST_FREQUENT, MOST_FREQUENT, FREQUENT_FROM = 256, 1 << 19, 1 << 22, 8
#: Fingerprints that a task counts at a time, those of a piece of the key space (about), and the bounds of the pieces' number.
COUNTED, PIECE, LEAST_PIECES, MOST_PIECES = 1 << 21, 1 << 20, 256, 1 << 16
#: Bytes of text for an n-gram, about.
NGRAM_BYTES = 6
#: Shared n-grams that a candidate pair needs, and documents of a rare n-gram.
SHARED, SMALL = 3, 64
#: Documents of a small cluster, documents of small clusters that share a task, and documents and n-grams in a block of a large one.
CLUSTER, GROUPED, BLOCK, BLOCK_PRINTS = 64, 2048, 1024, 1 << 22
#: Ranges of fingerprints in a class of the order: a fragment each. Columns of a matrix product.
RANGES, COLUMNS = 4, 2048

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return (h ^ (h >> np.uint64(29))) * _C ^ (h >> np.uint64(17))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A random 64-bit value for each byte, from its digest; A-Z have those of a-z."""
    value = [int.from_bytes(hashlib.sha256(b"word" + bytes([b])).digest()[:8], "little") for b in range(256)]
    return np.array([value[b + 32] if 65 <= b <= 90 else value[b] for b in range(256)], np.uint64)


@lru_cache(maxsize=1)
def _blank() -> np.ndarray:
    return np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(1 << max(14, (n - 1).bit_length()), b, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(tables)
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: differences of one running sum over the bytes, moved to a common place."""
    codes = np.frombuffer(data, np.uint8)
    if not len(codes):
        return np.array([], np.uint64)
    edge = np.diff(np.concatenate([[True], _blank()[codes], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.array([], np.uint64)
    power, inverse = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_byte_values()[codes] * power[: len(codes)], dtype=np.uint64, out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _A)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct fingerprints of the text's word n-grams."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    size = min(width, len(words))
    h = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        h = _mix(h * _A + words[i : len(words) - size + 1 + i])
    return np.unique(h)


def least_overlap(a, b, share: tuple[int, int]):
    """Shared n-grams that two sets of these sizes need: the least o with 100 o >= 85 (a + b - o), for share (85, 100)."""
    top, whole = share
    return -(-top * (a + b) // (top + whole))


@dataclass(frozen=True)
class Order:
    """What steers the order: the filter of shared n-grams, in pieces by the key's first bits, and the frequent ones."""

    pieces: int
    filter: np.ndarray
    frequent: np.ndarray
    counts: np.ndarray

    def shared(self, prints: np.ndarray) -> np.ndarray:
        bits = self.filter.size * 8 // self.pieces
        piece, places = _places(prints >> np.uint64(64 - KEY_BITS), self.pieces, bits)
        return np.logical_and.reduce([(self.filter[(at := piece * bits + p) >> 3] >> (at & 7).astype(np.uint8)) & 1 for p in places]).astype(bool)

    def classes(self, prints: np.ndarray) -> np.ndarray:
        """0 for most n-grams, else a class of counts: it goes up with each factor of four."""
        if not len(self.frequent):
            return np.zeros(len(prints), np.int64)
        key = prints >> np.uint64(64 - KEY_BITS)
        at = np.minimum(np.searchsorted(self.frequent, key), len(self.frequent) - 1)
        return np.where(self.frequent[at] == key, np.log2(self.counts[at]).astype(np.int64) // 2, 0)

    def front(self, prints: np.ndarray, size: int) -> np.ndarray:
        """The first n-grams of a set in the order: by class, then fingerprint."""
        return prints[np.lexsort((prints, self.classes(prints)))[:size]]

    def fragments(self, prints: np.ndarray) -> np.ndarray:
        """The fragment of each n-gram: RANGES contiguous pieces of the order in each class."""
        return self.classes(prints) * RANGES + (prints >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)


def _places(keys: np.ndarray, pieces: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each key: its piece, and its two bits there."""
    piece = (keys >> np.uint64(KEY_BITS - pieces.bit_length() + 1)).astype(np.int64)
    return piece, [(_mix(keys * m) & np.uint64(bits - 1)).astype(np.int64) for m in (_A, _B)]


def _power_of_two(n: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


def count_order(docs: DataFrame, text: str, width: int) -> Order:
    """One pass over all texts; what reaches the driver is bounded (MOST_FILTER bits, and MOST_FREQUENT n-grams)."""
    ngrams = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // NGRAM_BYTES
    pieces = _power_of_two(ngrams // PIECE, LEAST_PIECES, MOST_PIECES)
    bits = _power_of_two(ngrams, LEAST_FILTER, MOST_FILTER) // pieces
    most = min(MOST_FREQUENT, max(LEAST_FREQUENT, ngrams // FREQUENT_SHARE)) // pieces
    shift = KEY_BITS - pieces.bit_length() + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        pack = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) >> np.uint64(64 - KEY_BITS), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(pieces + 1, dtype=np.uint64) << np.uint64(shift))
            rows = []
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = keys[cuts[i] : cuts[i + 1]]
                gaps = np.diff(part, prepend=np.uint64(i << shift)).astype("<u4")
                # bytes of equal weight stand together, which compresses best
                planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()
                rows.append((i, len(part), pack.compress(planes), pack.compress(np.minimum(n[cuts[i] : cuts[i + 1]], 65535).astype("<u2").tobytes())))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["piece", "n", "gaps", "counts"]).cast(counted)

        for batch in batches:
            for t in batch.column(0):  # one text at a time
                prints = shingles(t.as_py(), width)
                if len(prints):
                    held.append(prints)
                    size += len(prints)
                if size >= COUNTED:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    counted = pa.schema([("piece", pa.int32()), ("n", pa.int64()), ("gaps", pa.binary()), ("counts", pa.binary())])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        piece = int(part["piece"].iloc[0])
        keys, counts = [], []
        for row in part.itertuples(index=False):
            planes = np.frombuffer(unpack.decompress(row.gaps), np.uint8).reshape(4, -1)
            gaps = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.uint64)
            keys.append(np.uint64(piece << shift) + np.cumsum(gaps, dtype=np.uint64))
            counts.append(np.frombuffer(unpack.decompress(row.counts), "<u2").astype(np.int64))
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        many = found[total > 1]
        mask = np.zeros(bits, np.uint8)
        for p in _places(many, pieces, bits)[1]:
            mask[p] = 1
        often = np.flatnonzero(total >= FREQUENT_FROM)
        often = np.sort(often[np.lexsort((found[often], -total[often]))[:most]])
        return pd.DataFrame({"piece": [piece], "bits": [np.packbits(mask, bitorder="little").tobytes()], "often": [found[often].astype("<u8").tobytes()], "counts": [total[often].astype("<i8").tobytes()]})

    rows = docs.select(text).mapInArrow(count, "piece int, n long, gaps binary, counts binary")
    merged = rows.groupBy("piece").applyInPandas(merge, "piece int, bits binary, often binary, counts binary").collect()
    flags = np.zeros(bits * pieces // 8, np.uint8)
    for r in merged:
        flags[r.piece * bits // 8 : (r.piece + 1) * bits // 8] = np.frombuffer(r.bits, np.uint8)
    often = np.frombuffer(b"".join(bytes(r.often) for r in merged), "<u8")
    order = np.argsort(often)
    return Order(pieces, flags, often[order], np.frombuffer(b"".join(bytes(r["counts"]) for r in merged), "<i8")[order])


def signatures(docs: DataFrame, key: str, text: str, width: int, share: tuple[int, int], order: Order) -> DataFrame:
    """key, sig (128 bits of the set's digest), n (its size), shared n-grams among the first ones (token, place), and the text's digest."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    schema = docs.select(key).schema.add("sig", T.BinaryType()).add("n", T.LongType()).add("tokens", T.ArrayType(T.LongType())).add("places", T.ArrayType(T.IntegerType())).add("digest", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                sig, n, tokens, places = [], [], [], []
                for t in batch.column(1).to_pylist():
                    prints = shingles(t, width)
                    size = len(prints)
                    sig.append(hashlib.sha256(prints.tobytes()).digest()[:16] if size else None)
                    n.append(size)
                    front = shared.value.front(prints, size - least_overlap(size, -(-share[0] * size // share[1]), share) + SHARED)
                    at = np.flatnonzero(shared.value.shared(front))
                    tokens.append(front[at].view(np.int64))
                    places.append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), batch.column(2)],
                    names=schema.fieldNames(),
                )

    return docs.select(key, text, _digest(text).alias("digest")).mapInArrow(run, schema)


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def candidate_clusters(nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, root): clusters of nodes that may link, from nodes (node, n, tokens, places)."""
    rows = nodes.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("node", "n", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    # written, so that the join has a plain exchange on each side and Spark may split the documents of one n-gram
    groups = materialize(rows.groupBy("token").agg(F.count("*").alias("docs"), F.min("node").alias("hub")).filter(F.col("docs") > 1), "ngrams")
    grouped = materialize(rows.join(groups, "token"), "shared-ngrams")
    rare = grouped.filter(F.col("docs") <= SMALL)
    other = rare.select(F.col("token").alias("token2"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    needed = F.ceil(F.lit(share[0]) * (F.col("n") + F.col("n2")) / F.lit(sum(share)))
    near = (F.col("place") <= F.col("n") - needed + SHARED - 1) & (F.col("place2") <= F.col("n2") - needed + SHARED - 1)
    sized = F.least("n", "n2") * share[1] >= F.greatest("n", "n2") * share[0]
    met = rare.join(other, (F.col("token") == F.col("token2")) & (F.col("node") < F.col("node2")) & sized & near)
    pairs = met.groupBy("node", "node2").agg(F.count("*").alias("common"), F.first(needed).alias("needed")).filter(F.col("common") >= F.least(F.lit(SHARED), "needed"))
    ties = grouped.filter((F.col("docs") > SMALL) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return components(pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).unionByName(ties))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one: products of 0/1 matrices over their common n-grams."""
    flat = [np.concatenate(left), np.concatenate(right)]
    vocabulary = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if left is right:
        vocabulary, n = np.unique(flat[0], return_counts=True)
        vocabulary = vocabulary[n > 1]
    total = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for side, prints in zip((left, right), flat, strict=True):
        if not len(vocabulary):
            break
        owner = np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.minimum(np.searchsorted(vocabulary, prints), len(vocabulary) - 1)
        hit = vocabulary[at] == prints
        by = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][by], owner[hit][by]))
    for first in range(0, len(vocabulary), COLUMNS):
        width = min(COLUMNS, len(vocabulary) - first)
        parts = []
        for side, (at, owner) in zip((left, right), placed, strict=True):
            lo, hi = np.searchsorted(at, [first, first + width])
            m = np.zeros((len(side), width), np.float32)
            m[owner[lo:hi], at[lo:hi] - first] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def meeting_pairs(groups: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets of one group (of CLUSTER sets at most) that share an n-gram: first, second, and how many they share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    prints = np.concatenate(sets)
    by = np.lexsort((owner, prints, groups[owner]))
    owner, prints, group = owner[by], prints[by], groups[owner][by]
    found = []
    for step in range(1, len(owner)):  # an n-gram's documents stand side by side: neighbours at each distance
        same = (prints[step:] == prints[:-step]) & (group[step:] == group[:-step])
        if not same.any():
            break
        found.append(owner[:-step][same] * len(sets) + owner[step:][same])
    codes, n = np.unique(np.concatenate(found) if found else np.array([], np.int64), return_counts=True)
    return codes // len(sets), codes % len(sets), n


_PARTIAL = "pack long, i int, j int, `left` binary, `right` binary, left_n binary, right_n binary, common binary"


def partial_overlaps(part: pd.DataFrame) -> pd.DataFrame:
    """One fragment of small clusters (pack < 0: pairs side by side), or of two blocks of a large one (a matrix): the nodes
    on both sides, their sets' sizes, and what they share in the fragment."""
    pack, i, j = int(part["pack"].iloc[0]), int(part["i"].iloc[0]), int(part["j"].iloc[0])
    nodes, sizes = part["node"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
    sets = [np.frombuffer(s, np.uint64) for s in part["prints"]]
    if pack < 0:
        a, b, common = meeting_pairs(np.unique(part["root"].to_numpy(), return_inverse=True)[1], sets)
        a, b = np.where(nodes[a] < nodes[b], a, b), np.where(nodes[a] < nodes[b], b, a)
    else:
        block = part["block"].to_numpy()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        left = [sets[x] for x in a]
        common = overlaps(left, left if i == j else [sets[x] for x in b]) if len(a) and len(b) else np.zeros((len(a), len(b)), np.int64)
    if not common.any():
        return pd.DataFrame({c: [] for c in ("pack", "i", "j", "left", "right", "left_n", "right_n", "common")})
    data = zstandard.ZstdCompressor(level=1).compress(common.astype("<u4" if common.max() > 65535 else "<u2").tobytes())
    sides = [x.astype("<i8").tobytes() for x in (nodes[a], nodes[b], sizes[a], sizes[b])]
    return pd.DataFrame({"pack": [pack], "i": [i], "j": [j], "left": [sides[0]], "right": [sides[1]], "left_n": [sides[2]], "right_n": [sides[3]], "common": [data]})


def _roots(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links: the least index that each index reaches."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.zeros(len(linked), bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = linked[front].any(0) & (root < 0)
    return root


def _pair_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of links between indices: the least index that each index reaches."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], np.int64)


def decide(part: pd.DataFrame, share: tuple[int, int]) -> pd.DataFrame:
    """Sum the fragments' partial overlaps, pair by pair, and decide: node, root (a linked node), links; linked nodes only."""
    unpack = zstandard.ZstdDecompressor()
    rows = []
    for r in part.itertuples(index=False):
        left, right, left_n, right_n = (np.frombuffer(x, "<i8") for x in (r.left, r.right, r.left_n, r.right_n))
        cells = len(left) if r.pack < 0 else len(left) * len(right)
        data = unpack.decompress(r.common)
        rows.append((left, right, left_n, right_n, np.frombuffer(data, "<u2" if len(data) == 2 * cells else "<u4").astype(np.int64)))
    names, at = np.unique(np.concatenate([x for r in rows for x in r[:2]]), return_index=True)
    sizes = np.concatenate([x for r in rows for x in r[2:4]])[at]
    if int(part["pack"].iloc[0]) < 0:
        codes = np.concatenate([np.searchsorted(names, r[0]) * len(names) + np.searchsorted(names, r[1]) for r in rows])
        pairs, where = np.unique(codes, return_inverse=True)
        a, b = pairs // len(names), pairs % len(names)
        linked = np.bincount(where, np.concatenate([r[4] for r in rows])) >= least_overlap(sizes[a], sizes[b], share)
        root, links = _pair_roots(a[linked], b[linked], len(names)), np.bincount(np.concatenate([a[linked], b[linked]]), minlength=len(names))
    else:
        left, right = (np.unique(np.concatenate([r[side] for r in rows])) for side in (0, 1))
        total = np.zeros((len(left), len(right)), np.int32)
        for r in rows:
            total[np.ix_(np.searchsorted(left, r[0]), np.searchsorted(right, r[1]))] += r[4].reshape(len(r[0]), len(r[1])).astype(np.int32)
        a, b = np.searchsorted(names, left), np.searchsorted(names, right)
        linked = np.zeros((len(names), len(names)), bool)
        linked[np.ix_(a, b)] = total >= least_overlap(sizes[a][:, None], sizes[b][None, :], share)
        linked |= linked.T
        np.fill_diagonal(linked, False)
        root, links = _roots(linked), linked.sum(1)
    kept = links > 0
    return pd.DataFrame({"node": names[kept], "root": names[root[kept]], "links": links[kept].astype(np.int64)})


def set_classes(docs: DataFrame, key: str, text: str, width: int = 4, share: tuple[int, int] = (85, 100)) -> DataFrame:
    """key, n_shingles, component_id (least key of the component), links (other sets that its set links to)."""
    order = count_order(docs, text, width)
    signed = materialize(signatures(docs, key, text, width, share, order), "signatures")
    sets = signed.filter(F.col("n") > 0).groupBy("sig").agg(F.min(F.struct(F.struct(key, "digest").alias("rep"), "n", "tokens", "places")).alias("s"), F.min(key).alias("least")).select("sig", "s.*", "least")
    bucket = F.pmod(F.xxhash64("sig"), F.lit(1024)).cast("int")
    nodes = materialize(gapless(materialize(sets, "sets").withColumn("_g", F.lit(0)), ["_g"], bucket, [F.col("sig")], "node", 1024).drop("_g"), "nodes")
    clusters = materialize(candidate_clusters(nodes, share).join(nodes.select("node", "rep", "n"), "node"), "clusters")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("prints"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("prints") / BLOCK_PRINTS)).cast("int")
    sizes = sizes.withColumn("blocks", blocks).withColumn("small", (F.col("members") <= CLUSTER) & (F.col("blocks") == 1)).drop("members", "prints")
    parts = _fragments(docs, clusters.join(sizes, "root"), key, text, width, order)
    # small clusters share a task; a large one's blocks meet two by two
    pack = F.when(F.col("small"), -1 - F.pmod(F.xxhash64("root"), F.lit(max(1, clusters.count() // GROUPED)))).otherwise(F.col("root"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = parts.withColumn("pack", pack).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    partial = dealt.groupBy("pack", "i", "j", "fragment").applyInPandas(partial_overlaps, _PARTIAL)
    decided = partial.groupBy("pack", "i", "j").applyInPandas(lambda part: decide(part, share), "node long, root long, links long")
    decided = materialize(decided, "decided")
    classes = components(decided.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = decided.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("sig", "node", "least").join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "named")
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_sig = named.join(firsts, "root").select(F.col("sig").alias("_sig"), "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    full = signed.filter(F.col("n") > 0).select(key, F.col("n").alias("n_shingles"), "sig").join(by_sig, F.col("sig") == F.col("_sig")).select(key, "n_shingles", "component_id", "links")
    empty = signed.filter(F.col("n") == 0).select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"), F.lit(0).cast("long").alias("links"))
    return full.unionByName(empty)


def _fragments(docs: DataFrame, placed: DataFrame, key: str, text: str, width: int, order: Order) -> DataFrame:
    """The sets of the clusters' nodes cut at the fragments' borders: node, root, blocks, small, n, fragment, prints (bytes).

    Sets come from the rows that stand for the nodes: by key and text digest, so those that repeat are equal and one of
    them is enough.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)
    rows = docs.select(F.struct(F.col(key), _digest(text).alias("digest")).alias("rep"), F.col(text).alias("text")).join(placed.select("rep", "node", "root", "blocks", "small", "n"), "rep")
    rows = rows.select("text", "node", "root", "blocks", "small", "n").dropDuplicates(["node"])
    schema = "node long, root long, blocks int, small boolean, n long, fragment int, prints binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                at, fragments, parts = [], [], []
                for row, t in enumerate(batch.column(0).to_pylist()):
                    prints = shingles(t, width)
                    fragment = shared.value.fragments(prints)
                    by = np.argsort(fragment, kind="stable")
                    names, starts = np.unique(fragment[by], return_index=True)
                    at += [row] * len(names)
                    fragments += names.tolist()
                    parts += [p.tobytes() for p in np.split(prints[by], starts[1:])]
                kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fragments, pa.int32()), pa.array(parts, pa.binary())], names=["node", "root", "blocks", "small", "n", "fragment", "prints"])

    return rows.mapInArrow(run, schema)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return set_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


OP8_SQL = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s
    from words),
tokens as (select doc_id, len(s) as n, unnest(s) as t from sets),
pairs as (
    select a.doc_id as a, b.doc_id as b
    from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached as (select a as doc_id, a as root from (select distinct a from pairs) union select p.b, r.root from reached r join pairs p on p.a = r.doc_id),
firsts as (select doc_id, min(root) as root from reached group by doc_id),
degree as (
    select a as doc_id, count(distinct k.s) as links
    from pairs p join (select doc_id, list_sort(s) as s from sets) k on k.doc_id = p.b
    join (select doc_id, list_sort(s) as s from sets) o on o.doc_id = p.a where o.s <> k.s group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(f.root, s.doc_id) as component_id, coalesce(d.links, 0)::bigint as links
from sets s left join firsts f on f.doc_id = s.doc_id left join degree d on d.doc_id = s.doc_id"""
